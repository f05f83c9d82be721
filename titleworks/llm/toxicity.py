"""Toxic texts by a learned lexicon, matched with misspellings, and by what stands around each match.

The lexicon holds words and beginnings of words that labelled toxic texts have and clean ones do not. It is kept as a
trie; the Levenshtein automata of its terms, run side by side over the trie, become one table of states, and a text's
words go through that table together, one character a step. A window of words around every match tells quotation from
abuse (quotation marks, words of reporting, the reader addressed, other matches), and a logistic regression over a
text's matches gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import flat, pieces, shingle_hashes, word_hashes
from titleworks.session import settle

TOXIC_SAMPLE = 3000  # labelled toxic texts that lexicon and regression are fitted on, about
CLEAN_SAMPLE = 5000  # labelled clean texts, about
STEMS = range(4, 9)  # lengths of beginnings that may be terms
LEAST_SHARE = 0.5  # of a term's labelled texts that are toxic
CHANCE = 1.0  # terms that chance alone may bring into the lexicon, in expectation
HELD_STEMS = 100_000  # entries a task holds before it gives its counts away
PIECE = 1 << 19  # bytes of text worked on at once (a longer document is one piece)
WINDOW = 8  # words on each side of a match
QUOTED_PART = 0.3  # of a quoted match that counts as abuse before anything is learned about quoted ones

# Words that report somebody's words, words that address the reader, quotation marks, marks inside misspelled words.
REPORTING = "called calls means quote quoted quotes said says term word words wrote nannte sagt sagte wort zitat appelle cite disait dit mot cita dice dijo palabra".split()
ADDRESSING = "you your yourself du dich dir dein tu toi vous votre tus usted".split()
QUOTES = '"«»“”„‹›'
INNER = "!$*@"

_SIZE = 0x110000
_LOWER = np.arange(_SIZE, dtype=np.uint32)
for _c in range(0x530):  # Latin, Greek and Cyrillic
    _LOWER[_c] = ord(chr(_c).lower()) if len(chr(_c).lower()) == 1 else _c
_WORDLY = np.ones(_SIZE, bool)
_WORDLY[:0x80] = [chr(c).isalnum() for c in range(0x80)]
for _low, _high in ((0x80, 0xC0), (0x2000, 0x2070), (0x3000, 0x3004), (0x3008, 0x3012), (0xFE00, 0xFE10), (0xFEFF, 0xFF00)):
    _WORDLY[_low:_high] = [chr(c).isalpha() for c in range(_low, _high)]


def edits_of(term: str, whole: bool) -> int:
    """Edits that a match of a term may have: long terms are seldom met by chance."""
    return (len(term) >= 5) + (len(term) >= 9) if whole else int(len(term) >= 6)


class Automaton:
    """All terms' Levenshtein automata over their trie, as one table: state by character to state. State 0 is dead, 1 the start.

    terms are (text, whole, edits): a whole term matches words within that many insertions, deletions and substitutions,
    any other one words that begin so. `ends[state]` is the match of a word that ends there, -1 or term * 4 + edits,
    with the fewest edits (of equal ones the beginning met first, then the smallest term); `final` are the states that no further character changes.
    """

    def __init__(self, terms: list[tuple[str, bool, int]]) -> None:
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        room, held = [-1], [[]]  # the most edits of a term below a node, terms that end there
        for number, (term, _, edits) in enumerate(terms):
            node = 0
            room[0] = max(room[0], edits)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    room.append(-1)
                    held.append([])
                node = children[node][c]
                room[node] = max(room[node], edits)
            held[node].append(number)
        alphabet = sorted({c for term, _, _ in terms for c in term})
        self.classes = np.zeros(_SIZE, np.uint16)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)

        def closed(found: dict[int, int], best: tuple[int, int] | None) -> tuple:
            """With what leaving characters out reaches, and the best beginning met; worse places are left out."""
            todo = deque(found.items())
            while todo:
                node, e = todo.popleft()
                if found[node] < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= room[child] and found.get(child, 9) > e + 1:
                        found[child] = e + 1
                        todo.append((child, e + 1))
            for node, e in found.items():
                for number in held[node]:
                    if not terms[number][1] and e <= terms[number][2]:
                        best = min(best, (e, number)) if best else (e, number)
            live = frozenset((n, e) for n, e in found.items() if best is None or e < best[0])
            return live, best

        def step(state: tuple, c: str | None) -> tuple:
            found: dict[int, int] = {}
            for node, e in state[0]:
                if e + 1 <= room[node]:
                    found[node] = min(found.get(node, 9), e + 1)
                for x, child in children[node].items():
                    cost = e + (x != c)
                    if cost <= room[child] and found.get(child, 9) > cost:
                        found[child] = cost
            return closed(found, state[1])

        start = closed({0: 0}, None)
        number_of, states, table = {(frozenset(), None): 0, start: 1}, [(frozenset(), None), start], []
        while len(table) < len(states):
            state, row = states[len(table)], []
            for c in [None, *alphabet]:
                to = step(state, c) if state[0] else state
                if to not in number_of:
                    number_of[to] = len(states)
                    states.append(to)
                row.append(number_of[to])
            table.append(row)
        self.table = np.array(table, np.int32)
        self.ends = np.full(len(states), -1, np.int32)
        for k, (live, best) in enumerate(states):
            whole = [(e, t) for n, e in live for t in held[n] if terms[t][1] and e <= terms[t][2]]
            for e, t in [min([*whole, *([best] if best else [])])] if whole or best else []:
                self.ends[k] = t * 4 + e
        self.final = (self.table == np.arange(len(states))[:, None]).all(axis=1)

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The match of each word, -1 or term * 4 + edits; words are ranges of code points."""
        classes = self.classes[points]
        out = np.full(len(starts), -1, np.int32)
        live, at, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), np.int32)
        while len(live):
            over = (at >= ends[live]) | self.final[state]
            out[live[over]] = self.ends[state[over]]
            on = ~over
            live, at, state = live[on], at[on], state[on]
            state = self.table[state, classes[at]]
            at += 1
        return out


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: longest runs of letters and digits, and of a few marks between two of them."""
    wordly = _WORDLY[points]
    if len(points) > 2:
        inner = np.isin(points[1:-1], [ord(c) for c in INNER])
        wordly[1:-1] |= inner & wordly[:-2] & wordly[2:]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], wordly, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of texts, each ended by a line break, and the texts' offsets."""
    decoded = [t.decode("utf-8", "replace") + "\n" for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in decoded])]).astype(np.int64)
    return _LOWER[np.frombuffer("".join(decoded).encode("utf-32-le", "replace"), np.uint32)], at


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    data, at = flat(column)
    whole = memoryview(data)
    for low, high in pieces(at, PIECE):
        yield low, high, [bytes(whole[at[i] : at[i + 1]]) for i in range(low, high)]


FEATURES = 8  # abuse by exact words, beginnings, one edit, more edits; quoted; matches a word; different terms; heaviest term


class Scorer:
    """A lexicon with its terms' weights, and the regression over a text's matches."""

    def __init__(self, lexicon: list[tuple[str, bool, float]]) -> None:
        own = {term for term, _, _ in lexicon}
        marks = [(w, k) for k, words in (("report", REPORTING), ("address", ADDRESSING)) for w in words if w not in own]
        self.weight = np.array([w for _, _, w in lexicon] + [0.0] * len(marks))
        self.kind = np.array([0] * len(lexicon) + [1 if k == "report" else 2 for _, k in marks], np.int8)
        self.automaton = Automaton([(t, whole, edits_of(t, whole)) for t, whole, _ in lexicon] + [(w, True, 0) for w, _ in marks])
        self.whole = np.array([whole for _, whole, _ in self.automaton.terms], bool)
        self.coefficients, self.bias, self.middle, self.scale = np.zeros(FEATURES), 0.0, np.zeros(FEATURES), np.ones(FEATURES)

    def matches(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, term, edits, abuse) of every match of the lexicon, and the number of words of each text.

        abuse is 0 to 1: how far the window around the match speaks against a quotation.
        """
        points, at = _points(texts)
        starts, ends = words_of(points)
        found = self.automaton.match(points, starts, ends)
        rows = np.searchsorted(at, starts, "right") - 1
        first = np.searchsorted(starts, at)
        place = np.flatnonzero(found >= 0)
        term, edits = found[place] // 4, found[place] % 4
        kind = self.kind[term]
        hit = place[kind == 0]
        low, high = np.maximum(hit - WINDOW, first[rows[hit]]), np.minimum(hit + WINDOW, first[rows[hit] + 1] - 1)
        within = lambda which, a, b: np.searchsorted(which, b, "right") - np.searchsorted(which, a, "left")
        reported = within(place[kind == 1], np.maximum(hit - WINDOW // 2, low), hit) > 0
        addressed = within(place[kind == 2], low, high) > 0
        others = within(hit, low, high) - 1
        strength = 2.0 + 0.7 * addressed + 0.5 * np.minimum(others, 2) - 1.5 * reported - 3.0 * self._quoted(points, starts, ends, hit, low, high)
        plain = 1 + np.exp(-2.0)  # a match with nothing telling around it is abuse as a whole
        return rows[hit], term[kind == 0], edits[kind == 0], np.minimum(1.0, plain / (1 + np.exp(-strength))), np.diff(first)

    @staticmethod
    def _quoted(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the last quotation mark before a match, inside its window, opens, and the first one behind it closes."""
        mark = np.flatnonzero(np.isin(points, [ord(c) for c in QUOTES]))
        if not len(mark) or not len(hit):
            return np.zeros(len(hit), bool)
        gap = np.isin(points, [9, 10, 11, 12, 13, 32, ord("("), ord("[")])
        opens = (mark == 0) | gap[np.maximum(mark - 1, 0)]
        closes = ~gap[np.maximum(mark - 1, 0)]
        before = np.searchsorted(mark, starts[hit]) - 1
        behind = np.searchsorted(mark, ends[hit])
        b, a = np.maximum(before, 0), np.minimum(behind, len(mark) - 1)
        left = (before >= 0) & (mark[b] >= starts[low] - 1) & opens[b]
        return left & (behind < len(mark)) & (mark[a] <= ends[high]) & closes[a]

    def features(self, texts: list[bytes]) -> np.ndarray:
        row, term, edits, abuse, words = self.matches(texts)
        n, weight, whole = len(texts), self.weight[term], self.whole[term]
        total = lambda which: np.bincount(row[which], (weight * (abuse + QUOTED_PART * (1 - abuse)))[which], n)
        exact = edits == 0
        sums = [total(exact & whole), total(exact & ~whole), total(edits == 1), total(edits > 1), np.bincount(row[exact], (weight * (1 - abuse))[exact], n)]
        density = np.bincount(row[exact], abuse[exact], n) * 100 / np.maximum(words, 1)
        pairs = np.unique(row[exact] * np.int64(len(self.weight)) + term[exact])
        heaviest = np.zeros(n)
        np.maximum.at(heaviest, row[exact], (weight * abuse)[exact])
        return np.stack([*(np.log1p(x) for x in sums), np.log1p(density), np.log1p(np.bincount(pairs // len(self.weight), minlength=n)), heaviest], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, offset: float, ridge: float = 1.0) -> Scorer:
        """Logistic regression by Newton's steps; offset is the log of how much more often toxic texts were chosen than clean ones."""
        self.middle, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack([(x - self.middle) / self.scale, np.ones(len(x))])
        beta, penalty = np.zeros(z.shape[1]), np.diag([ridge] * (z.shape[1] - 1) + [1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
            beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        self.coefficients, self.bias = beta[:-1], float(beta[-1]) - offset
        return self

    def odds(self, texts: list[bytes]) -> np.ndarray:
        return (self.features(texts) - self.middle) / self.scale @ self.coefficients + self.bias


def _prints(texts: DataFrame) -> DataFrame:
    """(doc_id, label, text, print): near copies mostly share the smallest hash of their five-word runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(2))
            found = np.zeros(len(at) - 1, np.uint64)
            for low, high in pieces(at):
                h, rows = word_hashes(data[at[low] : at[high]], at[low : high + 1] - at[low])
                runs, to = shingle_hashes(h, rows, 5)
                has = np.flatnonzero(to[1:] > to[:-1])
                if len(has):
                    found[low + has] = np.minimum.reduceat(runs, to[:-1][has])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=["doc_id", "label", "text", "print"])

    return texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, text string, print bigint")


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(term, whole, toxic, clean): texts of each label with a word, or with a word that begins so."""

    def rows(held: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        every = list(held[0].keys() | held[1].keys())
        for low in range(0, len(every), 20_000):
            keys = every[low : low + 20_000]
            columns = [pa.array([t for t, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.bool_()), *(pa.array([held[k][x] for x in keys], pa.int64()) for k in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "whole", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for low, _, texts in _texts(batch.column(1)):
                for label, text in zip(labels[low:], texts, strict=False):
                    points, _ = _points([text])
                    starts, ends = words_of(points)
                    whole = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
                    words = {whole[a:b] for a, b in zip(starts, ends, strict=True)}
                    held[label].update({(w[:64], True) for w in words if 2 < len(w)} | {(w[:k], False) for w in words for k in STEMS if len(w) >= k})
                    if len(held[0]) + len(held[1]) > HELD_STEMS:
                        yield from rows(held)
                        held = {0: Counter(), 1: Counter()}
        yield from rows(held)

    found = sample.select("label", "text").mapInArrow(run, "term string, whole boolean, toxic bigint, clean bigint")
    return found.groupBy("term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chance(toxic: int, clean: int, rate: float) -> float:
    """The probability of at least so many toxic ones among toxic + clean texts, each being toxic at the rate."""
    n = toxic + clean
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
    return sum(math.exp(log(i)) for i in range(toxic, n + 1))


def choose(candidates: list[tuple[str, bool, int, int]], tried: int, toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """The lexicon: (term, whole, weight), weights being smoothed log odds.

    candidates are (term, whole, toxic texts, clean texts). A term must be too toxic for chance among `tried` ones. Of a
    beginning and the longer ones and words in the same toxic texts the longest stands; others that extend a term are left out.
    """
    rate = min(max(toxic / max(1, toxic + clean), 1e-6), 1 - 1e-6)
    able = [(chance(a, b, rate), t, w, a, b) for t, w, a, b in candidates if a >= 3 and a >= LEAST_SHARE * (a + b)]
    able = sorted(((p, t, w, a, b) for p, t, w, a, b in able if p * tried <= CHANCE), key=lambda x: (x[0], -len(x[1]), not x[2], x[1]))
    taken: list[tuple[str, bool, float, int]] = []
    for _, term, whole, a, b in able:
        if any((term.startswith(t) and not w) or t.startswith(term) for t, w, _, _ in taken):
            continue
        taken.append((term, whole, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)), a))
    return [(t, w, weight) for t, w, weight, _ in taken]


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE, known_terms: Sequence[str] = ()) -> Scorer:
    """Lexicon and regression from about `toxic` and `clean` labelled documents for which `training` (over doc_id) holds,
    chosen by a hash of the id.

    docs has doc_id and text; labels doc_id and the label, 0 or 1, other values and nulls are left out. Near copies
    among the chosen texts count once. Only counts of terms and matches come to the driver, never texts. Without labelled rows
    of both kinds there is nothing to tell them by, and every text gets the share of toxic ones (one half if there are none).
    known_terms are words that are in the lexicon whatever the labels say.
    """
    id_ = F.col("doc_id").cast("bigint")
    rows = labels.select(id_.alias("doc_id"), F.col(label).cast("int").alias("label")).where(training & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = {k: min(1.0, most / known[k]) if known.get(k) else 0.0 for k, most in ((0, clean), (1, toxic))}
    if not part[0] or not part[1]:
        scorer = Scorer([])
        scorer.bias = math.log((known.get(1, 0) + 0.5) / (known.get(0, 0) + 0.5))
        return scorer
    limit = F.when(F.col("label") == 1, int(part[1] * (1 << 40))).otherwise(int(part[0] * (1 << 40)))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < limit).distinct()
    found = settle(_prints(docs.select(id_.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")), "labelled")  # at most about toxic + clean rows
    single = found.groupBy("label", "print").agg(F.min("doc_id").alias("doc_id"))
    sample = settle(found.join(F.broadcast(single), ["label", "print", "doc_id"], "left_semi"), "sample")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = settle(_stem_counts(sample), "stems")
    tried = counts.where("toxic + clean >= 3").count()
    able = counts.where((F.col("toxic") >= 3) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))).collect()  # of a bounded sample
    lexicon = choose([(r["term"], r["whole"], r["toxic"], r["clean"]) for r in able], tried, size.get(1, 0), size.get(0, 0))
    usual = float(np.mean([w for _, _, w in lexicon])) if lexicon else 1.0
    scorer = Scorer(lexicon + [(t, True, usual) for t in dict.fromkeys(known_terms) if t not in {x for x, _, _ in lexicon}])
    held = sample.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([held.value.features(texts) for _, _, texts in _texts(batch.column(2))]) if batch.num_rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["doc_id", "label", *(f"x{k}" for k in range(FEATURES))])

    schema = "doc_id bigint, label int, " + ", ".join(f"x{k} double" for k in range(FEATURES))
    measured = sample.select("doc_id", "label", "text").mapInArrow(measure, schema).toPandas()
    measured = measured.sort_values(list(measured.columns), kind="stable")
    held.unpersist()
    offset = math.log(size.get(1, 1) / known[1]) - math.log(size.get(0, 1) / known[0])
    return scorer.fit(measured.iloc[:, 2:].to_numpy(), measured["label"].to_numpy(np.float64), offset)


def score(docs: DataFrame, scorer: Scorer, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns of docs (all, or those named), with `toxic_score`: the probability, 0 to 1, that a text is toxic.

    Whole texts are scored, by nothing but their characters. Null and empty texts have no matches and get the score of such
    a text. Every row is scored on its own. A column `toxic_score` is replaced; an empty table gives no rows.
    """
    kept = docs.drop("toxic_score")
    names = [c for c in (kept.columns if columns is None else columns) if c != "toxic_score"]
    place = kept.columns.index("text")
    schema = kept.select(*names).withColumn("toxic_score", F.lit(None).cast("double")).schema
    held = kept.sparkSession.sparkContext.broadcast(scorer)  # the lexicon's table of states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.concatenate([held.value.odds(texts) for _, _, texts in _texts(batch.column(place))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=[*names, "toxic_score"])

    return kept.mapInArrow(run, schema)
