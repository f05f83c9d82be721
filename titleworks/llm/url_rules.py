"""URL rules with wildcards, judged by a bit-parallel automaton over all rules at once.

Every rule's glob is written into one long bit string. A url moves all rules' states by one
shift, or and and a byte (Shift-And); wildcards are states that stay where they are. The states
of many urls are a matrix of 64-bit words, so a task advances a whole batch byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import flat, lowered, pieces


@dataclass(frozen=True)
class Rule:
    """`host/path`: fits the host, all its subdomains, and all paths that begin with /path.

    `*` stands for any run of bytes other than / in the host, and for any run in the path; `?` for
    one such byte. Of the rules that fit a url the one written longest decides; of those as long a
    blocking one, then the first in code-point order.
    """

    text: str
    allow: bool


class Automaton:
    """Bit masks of the rules. Bits of one rule lie in a row, and may cross into the next word."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.rules = sorted(rules, key=lambda r: (-len(r.text), r.allow, r.text))
        steps: list[tuple[int, object]] = []  # of each bit: the bytes it takes, and those it stays at
        first, last = [], []
        for rule in self.rules:
            host, slash, path = rule.text.partition("/")
            if not slash:
                raise ValueError(f"a rule is written host/path: {rule.text}")
            first.append(len(steps))
            steps.append((-1, "host"))  # a wildcard before the host's own dot: any subdomain
            for part, kind in ((f".{host}", "host"), (slash + path, "path")):
                for byte in part.encode():
                    steps.append((-1, kind) if byte == ord("*") else (-2 if byte == ord("?") and kind == "host" else -3 if byte == ord("?") else byte, None))
            last.append(len(steps) - 1)
        words = max(1, -(-len(steps) // 64))
        self.words = words
        self.take = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.skip = np.zeros(words, np.uint64)  # wildcards match nothing, too
        self.start = np.zeros(words, np.uint64)
        self.ends = np.zeros(words, np.uint64)
        self.rule_of = np.zeros(words * 64, np.int64)
        self.open = np.zeros(words, np.uint64)  # states that can still lead somewhere new
        ends = set(last)
        not_slash = [b for b in range(256) if b != 0x2F]
        for bit, (byte, kind) in enumerate(steps):
            w, one = bit // 64, np.uint64(1) << np.uint64(bit % 64)
            if bit in first:
                self.start[w] |= one
            if kind:
                self.stay[not_slash if kind == "host" else slice(None), w] |= one
                self.skip[w] |= one
            else:
                self.take[not_slash if byte == -2 else slice(None) if byte == -3 else byte, w] |= one
            if bit in ends:
                self.ends[w] |= one
                self.rule_of[bit] = last.index(bit)
            else:
                self.open[w] |= one

    def _shift(self, states: np.ndarray) -> np.ndarray:
        moved = states << np.uint64(1)
        moved[:, 1:] |= states[:, :-1] >> np.uint64(63)
        return moved & ~self.start

    def _closed(self, states: np.ndarray) -> np.ndarray:
        """Add what wildcards reach without a byte."""
        while True:
            more = states | (self._shift(states) & self.skip)
            if (more == states).all():
                return states
            states = more

    def judge(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each row of `.host/path` bytes the place of the deciding rule among self.rules, or -1."""
        rows = len(at) - 1
        best = np.full(rows, len(self.rules), np.int64)
        live = np.argsort(at[:-1] - at[1:], kind="stable")  # longest first
        # a state is the last bit matched; the leading wildcard has matched nothing yet
        states = self._closed(np.repeat(self.start[None, :], rows, 0))
        step = 0
        while len(live):
            states, live = states[: (n := int(np.sum(at[live + 1] - at[live] > step)))], live[:n]
            if not n:
                break
            byte = data[at[live] + step]
            states = self._closed((self._shift(states) & self.take[byte]) | (states & self.stay[byte]))
            ended = states & self.ends
            hit = np.flatnonzero(ended.any(axis=1))
            if len(hit):  # rules lie in their order, so the lowest bit is the deciding one
                word = (ended[hit] != 0).argmax(axis=1)
                low = ended[hit, word]
                bit = np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1] - 1
                best[live[hit]] = np.minimum(best[live[hit]], self.rule_of[word * 64 + bit])
            going = (states & self.open).any(axis=1)
            if not going.all():
                states, live = states[going], live[going]
            step += 1
        return np.where(best == len(self.rules), -1, best)


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? , # or the end, A-Z lower-cased; empty without ://, or for null."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], otherwise: bool = True, url: str = "url") -> DataFrame:
    """All columns of pages, with url_host, url_path, url_rule (null if none fits) and url_allowed.

    A prefix rule fits as soon as its last byte is reached, so a host rule needs the path's first /.
    A null url, or one without ://, has an empty host and path; no rule fits it, nor any other url
    that no rule names: `otherwise` decides those. Every row is judged on its own, repeated rows
    alike; an empty table gives no rows. Columns of the four names are replaced. The automaton grows
    with the rules, which the caller holds as a list; nothing grows with the pages.
    """
    machine = Automaton(rules)
    names = [r.text for r in machine.rules]
    allows = [r.allow for r in machine.rules]
    kept = pages.drop("url_host", "url_path", "url_rule", "url_allowed")
    shown = kept.withColumns({"url_host": host_of(F.col(url)), "url_path": path_of(F.col(url))})
    schema = shown.withColumns({"url_rule": F.lit(None).cast("string"), "url_allowed": F.lit(True)}).schema
    last = "_canonical"  # must be a name that pages do not have, so that it is the last column
    while last in (c.lower() for c in shown.columns):
        last = f"_{last}"
    shown = shown.withColumn(last, F.concat(F.lit("."), "url_host", "url_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(batch.num_columns - 1))
            found = [machine.judge(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in pieces(at, 1 << 19)]
            place = np.concatenate(found) if found else np.zeros(0, np.int64)
            rule = pa.array([names[k] if k >= 0 else None for k in place], pa.string())
            allowed = pa.array([allows[k] if k >= 0 else otherwise for k in place], pa.bool_())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, rule, allowed], names=[f.name for f in schema])

    return shown.mapInArrow(run, schema)
