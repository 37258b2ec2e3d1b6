import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from ragloom.session import get_spark, ship
    s = get_spark("local[4]", app="ragloom-llm-tests", shuffle_partitions=8)
    ship(s)
    yield s


#: Null, empty, blank, long, repeated and odd texts; ids repeat with equal rows.
EDGE_TEXTS = [None, "", "   ", "a", "é", "\n\n", "word " * 3000, "a" * 5000, "two  spaces\there", " lead", "tail ",
              "the same words again and again " * 3, "the same words again and again " * 3, "<|endoftext|> x", "▁a b",
              "中文 字符", "\x00 z", "x" + " " * 20 + "y"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts with columns named like the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, i, "x", True, [1]) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[3], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long, id string, "
                                       "kept boolean, tokens array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
