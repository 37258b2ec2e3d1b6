"""Texts of megabytes, unbroken runs, and a conversation of many thousand turns."""

import hashlib
import random

import pytest
import sentencepiece
import public_tokenizers as P
from pyspark.sql import functions as F

from ragloom.llm import (bpe, combination_join, compression, language, licenses, packing, preference, site_templates,
                         token_counts)


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(4000)]
    prose = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(90_000))
    return {1: prose, 2: "ab" * 100_000, 3: " " * 150_000 + "x", 4: "".join(rng.choices("abcdefgh", k=60_000)), 5: prose,
            6: "short text"}


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame([(i, t, "en") for i, t in long_texts.items()],
                                 "doc_id long, text string, lang string").repartition(3)


def test_tokenizers_and_packing(long_docs, long_texts):
    for r in bpe.encoding_digests(long_docs).collect():
        assert r.decoded_sha256 == hashlib.sha256(long_texts[r.doc_id].encode()).hexdigest()
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(long_docs).collect():
        assert r.n_bytes == len(long_texts[r.doc_id].encode())
        if r.doc_id in (1, 6):
            assert r.n_tokens == len(library.encode(long_texts[r.doc_id]))
    pieces = packing.pack(long_docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert all(r.n == r["all"] for r in pieces.collect())


def test_scans_and_verdicts(long_docs, long_texts):
    assert {r.doc_id: r.n_words for r in licenses.license_scan(long_docs).collect()}[2] == 1
    rules = {r.doc_id: r for r in compression.compression_quality(long_docs).collect()}
    assert rules[1].kept and rules[1].n_chunks > 50 and not rules[2].kept and not rules[3].kept
    assert {r.doc_id: r.lang_pred for r in language.identify_language(long_docs).collect()}[1] == "en"
    joined = {r.doc_id: r for r in combination_join.jaccard_components(long_docs).collect()}
    words = long_texts[1].split()
    assert joined[5].component_id == 1 and joined[4].component_id == 4 and joined[2].n_shingles == 1
    assert joined[1].n_shingles == len(set(zip(words, words[1:], words[2:])))


def test_page_of_megabytes(spark, long_texts):
    body = "".join(f"<div><p>{line}</p></div>" for line in long_texts[1].split("\n"))
    page = spark.createDataFrame([(1, "http://a.org", f"<body><nav>menu</nav><article>{body}</article></body>")],
                                 "page_id long, url string, html string")
    assert site_templates.extract_pages(page).first().text == " ".join(long_texts[1].split())


def test_conversation_of_many_turns(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    (pair,) = preference.preference_pairs(*preference.echo_negatives(turns)).collect()
    assert pair.n_prompt_turns == 19_999 and pair.n_chosen_turns == pair.n_rejected_turns == 1
    assert "turn 19999" in pair.chosen and "turn 19998" in pair.rejected
