"""License scans: phrases, and template markup compiled to token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_process, text_of
from .license_texts import TEMPLATES

#: Base phrases and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit"))
_MARK = re.compile(r"<<(.*?)>>", re.S)
# Lower-cases A-Z; what is no digit, letter or non-ASCII byte becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
                    for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """A token automaton: word and any-word edges, and free edges, from state 0 to ``end``."""
    word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_word: list[int | None] = field(default_factory=lambda: [None])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    end: int = 0
    mandatory: list[bytes] = field(default_factory=list)

    def state(self) -> int:
        self.word.append({})
        self.any_word.append(None)
        self.free.append([])
        return len(self.word) - 1

    def reach(self, states) -> frozenset[int]:
        """The states and all that free edges lead to."""
        known, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in known:
                    known.add(s)
                    todo.append(s)
        return frozenset(known)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        after = [self.word[s][word] for s in states if word in self.word[s]]
        after += [self.any_word[s] for s in states if self.any_word[s] is not None]
        return self.reach(after) if after else frozenset()

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest run of words from ``start`` that is accepted."""
        states, found, at = self.reach([0]), None, start
        while True:
            if self.end in states:
                found = at
            if at == len(words) or not states:
                return found
            states, at = self.step(states, words[at]), at + 1


def compile_template(markup: str) -> Automaton:
    """Markup to automaton. Optional regions nest; mandatory words stand outside all of them."""
    machine = Automaton()
    at, opened = 0, []
    for i, part in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            for word in words_of(part):
                after = machine.state()
                machine.word[at][word] = after
                if not opened:
                    machine.mandatory.append(word)
                at = after
            continue
        name, *options = part.split(";")
        if name == "beginOptional":
            inside = machine.state()
            machine.free[at].append(inside)
            opened.append(at)
            at = inside
        elif name == "endOptional":
            after = machine.state()
            machine.free[at].append(after)
            machine.free[opened.pop()].append(after)
            at = after
        elif name == "var":
            given = dict(o.split("=", 1) for o in options)
            least, most = map(int, given.get("words", "1-20").split("-"))
            skips = []
            for n in range(most):
                if n >= least:
                    skips.append(at)
                after = machine.state()
                machine.any_word[at] = after
                at = after
            after = machine.state()
            for s in (*skips, at):
                machine.free[s].append(after)
            at = after
        else:
            raise ValueError(f"unknown markup <<{part}>>")
    if opened:
        raise ValueError("an optional region is not closed")
    machine.end = at
    return machine


@dataclass
class Scanner:
    """Phrases and automata; a template is only tried where its mandatory words all occur."""
    phrases: tuple
    machines: dict[str, Automaton]

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) wherever the words of a phrase stand consecutively."""
        found, position = [], {}
        heads = {phrase.encode().split()[0] for phrase, _ in self.phrases}
        for i, w in enumerate(words):
            if w in heads:
                position.setdefault(w, []).append(i)
        for phrase, label in self.phrases:
            own = phrase.encode().split()
            found += [(i, label) for i in position.get(own[0], ()) if words[i:i + len(own)] == own]
        return sorted(found)

    def accepted(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(template, start, end) of all accepted runs, none inside another of its template."""
        have, found = set(words), []
        for name, machine in self.machines.items():
            if not have.issuperset(machine.mandatory):
                continue
            first, past = machine.reach([0]), 0
            begin = {w for s in first for w in machine.word[s]}
            for i, w in enumerate(words):
                if i >= past and (w in begin or any(machine.any_word[s] is not None for s in first)):
                    end = machine.match(words, i)
                    if end is not None and end > i:
                        found.append((name, i, end))
                        past = end
        return found


def scanner(phrases=PHRASES, templates: dict[str, str] | None = None) -> Scanner:
    return Scanner(phrases, {n: compile_template(t) for n, t in (templates or TEMPLATES).items()})


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "matches string, score double")


def scanned(text: Column, templates: dict[str, str] | None = None) -> Column:
    """Struct of the scan's results for a text column."""
    key = ("licenses", tuple(sorted((templates or TEMPLATES).items())))

    @F.pandas_udf(f"struct<{FIELDS}>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        tool = per_process(key, lambda: scanner(templates=templates))
        rows = []
        for text in texts:
            words = words_of(text or "")
            base, runs = tool.places(words), tool.accepted(words)
            names = {label for _, label in base}
            # Every word of an accepted run is accounted for; a bare phrase is half evidence.
            score = 1.0 if runs else 0.5 if base else 0.0
            rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                         ",".join(sorted(names)), ",".join(sorted(names | {n for n, _, _ in runs})),
                         ",".join(f"{n}:{a}-{b}" for n, a, b in runs), score))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: dict[str, str] | None = None) -> DataFrame:
    """Base phrases and accepted templates of every whole text.

    ``matches`` lists template:first-end word spans. Null and empty texts have no
    words, no labels (empty strings) and score 0. Rows are scanned alone, so
    repeated rows, ties and other columns have no effect; an empty table gives no rows.
    A template that is accepted is a label; texts of whole licenses are told by license
    and version. A text of any length is read in one pass a template that may occur in it.
    """
    return docs.select(F.col(id_col), scanned(text_of(text_col), templates).alias("found")).select(id_col, "found.*")
