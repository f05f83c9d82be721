"""Words and tags as weighted vectors of length one, in long and in packed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.session import settle

MAX_TERMS = 30_000
MIN_TITLES = 2
PIECE_WORDS = 250_000  # counted in one step, or one title
# Common English words (a parameter; pass another list for other texts).
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
# A stock sentence that stands for "no text".
PLACEHOLDER = r"(?iU)^\s*no synopsis (information )?has been added"
WORD = r"[\p{L}\p{N}_]{2,}"


def is_placeholder(synopsis: Column) -> Column:
    return F.coalesce(synopsis.rlike(PLACEHOLDER), F.lit(False))


def usable_text(synopsis: Column) -> Column:
    """The text, or null when it is missing, blank or the stock sentence."""
    return F.when(synopsis.rlike(r"(?U)[^\s\x1c-\x1f]") & ~is_placeholder(synopsis), synopsis)


def word_list(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of two letters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words))


def with_pairs(words: Column) -> Column:
    """The words, then all pairs of neighbouring words."""
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, F.concat(words, pairs)).otherwise(words)


def term_counts(titles: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(mal_id, term, tf), for one row a title: its words, and all pairs of neighbouring words.

    A title's terms are counted inside its row, so neither texts nor terms are shuffled. Words are numbered
    and counted as numbers, many titles at a time; list functions with lambdas would take every term one by one.
    """
    texts = titles.select("mal_id", usable_text(F.col("synopsis")).alias("text")).where("text is not null")
    words = texts.select("mal_id", word_list(F.col("text"), stop_words).alias("words"))
    return words.mapInArrow(_counted, f"mal_id {words.schema['mal_id'].dataType.simpleString()}, term string, tf bigint")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.columns
        words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + PIECE_WORDS, side="right")) - 1)
            own = words.slice(ends[low], ends[high] - ends[low])
            if len(own):
                yield _terms(ids.slice(low, high - low), own, lengths[low:high])
            low = high


def _terms(ids: pa.Array, words: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    """The distinct terms of some titles, from all their words in order and each title's number of words."""
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    rows = np.repeat(np.arange(len(lengths)), lengths)
    beside = np.flatnonzero(rows[1:] == rows[:-1])  # words that the same title goes on behind
    pairs, pair = np.unique(code[beside] * len(names) + code[beside + 1], return_inverse=True)
    n = len(names) + len(pairs)
    # A word has no blank, so no pair is a word.
    terms, tf = np.unique(np.concatenate([rows * n + code, rows[beside] * n + len(names) + pair]), return_counts=True)
    joined = pc.binary_join_element_wise(names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), " ")
    term = pa.concat_arrays([names, joined]).take(pa.array(terms % n))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(terms // n)), term, pa.array(tf, pa.int64())], names=["mal_id", "term", "tf"])


def vocabulary(counts: DataFrame, n_titles: int, max_terms: int = MAX_TERMS, min_titles: int = MIN_TITLES) -> DataFrame:
    """The most used terms (ties by name) with their number and smoothed inverse frequency.

    How often the last kept term is used comes from counts of counts; only terms used exactly so are sorted.
    """
    used = settle(
        counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_titles), "used"
    )
    level = F.floor(F.log2("cf") * 64)
    room, at = max_terms, None
    for r in used.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 64 a doubling
        if r.n > room:
            at = r.level
            break
        room -= r.n
    kept = used if at is None else used.where(level > at)
    if at is not None:
        for r in used.where(level == at).groupBy("cf").agg(F.count("*").alias("n")).orderBy(F.desc("cf")).collect():
            if r.n > room:
                last = used.where(F.col("cf") == r.cf).orderBy("term").limit(room)
                kept = used.where(F.col("cf") > r.cf).union(last)
                break
            room -= r.n
    idf = F.log((1 + F.lit(n_titles)) / (1 + F.col("df"))) + 1
    # At most max_terms rows.
    number = F.row_number().over(Window.orderBy("term")) - 1
    return kept.select("term", number.alias("term_id"), "df", idf.alias("idf"))


def text_vectors(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(mal_id, term_ids, weights): TF-IDF scaled to length one. Titles without a term are absent.

    A title has at most max_terms entries, so packing them keeps a row bounded. The vocabulary
    is broadcast: it has at most max_terms rows.
    """
    weighted = counts.join(F.broadcast(vocab.select("term", "term_id", "idf")), "term").select(
        "mal_id", "term_id", (F.col("tf") * F.col("idf")).alias("w")
    )
    # The length is an aggregate too: as an expression of the packed list it would be computed
    # again for every element.
    packed = weighted.groupBy("mal_id").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("e"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    return packed.select(
        "mal_id",
        F.col("e.term_id").alias("term_ids"),
        F.transform("e", lambda x: x["w"] / F.col("norm")).alias("weights"),
    )


def unpack_text(vectors: DataFrame) -> DataFrame:
    return vectors.select("mal_id", F.inline(F.arrays_zip("term_ids", "weights")).alias("term_id", "weight"))


def tag_sets(links: DataFrame) -> DataFrame:
    """(mal_id, tags): each title's distinct tags, sorted. Every tag weighs 1 / sqrt(how many)."""
    return links.groupBy("mal_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def tag_vectors(sets: DataFrame) -> DataFrame:
    weight = 1 / F.sqrt(F.size("tags"))
    return sets.select("mal_id", F.explode("tags").alias("tag"), weight.alias("weight"))
