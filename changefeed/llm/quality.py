"""Quality rules: repetition counts and bands of n-gram perplexity.

The language model is a modified Kneser-Ney model over characters, one for each value of ``lang``.
Characters become one of 64 symbols, so an n-gram of order four is a 24-bit code. A symbol that stands for
many signs passes its probability on to each of them in equal parts. Every text is counted: tasks count the codes of their rows (numpy), Spark adds them up, and one group per
language (at most 2**24 codes) turns counts into probabilities. A model is kept as sorted
arrays of codes with a value each; scoring finds codes by binary search.

The largest possible model of one language is known (order times 2**24 codes of twelve bytes), and its
actual size is read before use: models are handed to tasks as broadcasts of at most
``BROADCAST_BYTES``; where all languages together exceed that, documents are scored in several
passes of that many bytes of models each, with the same results.

Bands: the median log perplexity of a language plus and minus a multiple of the median absolute
deviation. Both are taken over all its documents; a language of few documents gets wide bands by ``least_spread``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.common import keyed, materialise, packed, unpacked, worker_cache

ORDER, SYMBOL_BITS, SIGN = 4, 6, 31
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
UPPER_BAND, LOWER_BAND, LEAST_SPREAD = 10.0, 10.0, 0.05
BROADCAST_BYTES = 256 << 20
FLUSH = 4_000_000


def _symbol(code: int) -> int:
    """0 start of text, 1 space, 2-27 letters, 28 digits, 29-31 signs, 32-63 all other letters."""
    c = chr(code)
    kind = unicodedata.category(c)
    if c.isspace():
        return 1
    if "a" <= c <= "z":
        return 2 + code - 97
    if kind[0] == "N":
        return 28
    if c in ".,;:!?":
        return 29
    if kind in ("Pd", "Ps", "Pe", "Pi", "Pf") or c in "'\"":
        return 30
    if kind[0] in "PSC":
        return SIGN
    return 32 + code % 32


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([_symbol(c) for c in range(0x3000)], np.uint8))
    return _TABLE[0]


def sign_cost() -> float:
    """Log of the number of signs that share symbol 31: each is as likely as any other of them."""
    return float(np.log((_table() == SIGN).sum()))


def symbols(text: str) -> np.ndarray:
    table, codes = _table(), np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], (32 + codes % 32).astype(np.uint8))


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams: one for each character, after three start symbols."""
    s = np.concatenate([np.zeros(ORDER - 1, np.uint32), symbols(text).astype(np.uint32)])
    n = len(s) - ORDER + 1
    out = np.zeros(n, np.uint32)
    for i in range(ORDER):
        out = (out << np.uint32(SYMBOL_BITS)) | s[i : i + n]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, code and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        held: dict[str | None, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(code), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [langs, pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "code", "n"]
                )
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if text:
                    held.setdefault(lang, []).append(grams(text))
                    size += len(text)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, code int, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more, by the closed form of modified Kneser-Ney."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [k - (k + 1) * y * above / at if at else k * y for k, at, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0] + [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)])


def model_of(code: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders one to ORDER: sorted codes, their log probabilities, sorted contexts, their log back-off weights."""
    levels = [(code.astype(np.int64), n.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols precede
        suffix, kinds = np.unique(levels[-1][0] & ((1 << (SYMBOL_BITS * order)) - 1), return_counts=True)
        levels.append((suffix, kinds.astype(np.float64)))
    out = []
    below_codes, below_p = np.arange(1 << SYMBOL_BITS), np.full(1 << SYMBOL_BITS, 1 / (1 << SYMBOL_BITS))
    for order, (codes, counts) in enumerate(reversed(levels), 1):
        order_by = np.argsort(codes, kind="stable")
        codes, counts = codes[order_by], counts[order_by]
        discount = _discounts(counts)[np.minimum(counts, 3).astype(np.int64)]
        contexts, at = np.unique(codes >> SYMBOL_BITS, return_inverse=True)
        total = np.bincount(at, counts)
        weight = np.bincount(at, discount) / total
        if order == 1:
            lower = below_p[codes]
        else:
            lower = below_p[np.searchsorted(below_codes, codes & ((1 << (SYMBOL_BITS * (order - 1))) - 1))]
        p = (counts - discount) / total[at] + weight[at] * lower
        out.append((codes, np.log(p), contexts, np.log(np.maximum(weight, 1e-12))))
        below_codes, below_p = codes, p
    return out


MODEL = "lang string, bytes long, codes array<binary>, logs array<binary>, contexts array<binary>, weights array<binary>"


def train(docs: DataFrame) -> DataFrame:
    """One row of sorted arrays for each language."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = model_of(pdf["code"].to_numpy(), pdf["n"].to_numpy())
        packed = [
            [np.asarray(level[i], kind).tobytes() for level in levels]
            for i, kind in enumerate((np.int32, np.float32, np.int32, np.float32))
        ]
        size = sum(len(x) for column in packed for x in column)
        lang = pdf["lang"].iloc[0]
        return pd.DataFrame([[None if pd.isna(lang) else lang, size, *packed]], columns=[c.split()[0] for c in MODEL.split(", ")])

    return count_grams(docs).groupBy("lang").applyInPandas(run, MODEL)


def unpack(row) -> list[tuple[np.ndarray, ...]]:  # noqa: ANN001
    kinds = (np.int32, np.float32, np.int32, np.float32)
    columns = [[np.frombuffer(x, k) for x in row[c]] for c, k in zip(("codes", "logs", "contexts", "weights"), kinds)]
    return list(zip(*columns))


def log_perplexity(text: str, levels: list[tuple[np.ndarray, ...]]) -> float:
    """Mean negative log probability of the characters; unseen n-grams back off to shorter ones."""
    code = grams(text).astype(np.int32)
    score = np.zeros(len(code))
    todo = np.arange(len(code))
    for order in range(ORDER, 0, -1):
        codes, logs, contexts, weights = levels[order - 1]
        part = code[todo] & ((1 << (SYMBOL_BITS * order)) - 1)
        at = np.minimum(np.searchsorted(codes, part), len(codes) - 1)
        seen = codes[at] == part
        score[todo[seen]] += logs[at[seen]]
        todo, part = todo[~seen], part[~seen]
        if not len(todo):
            break
        at = np.minimum(np.searchsorted(contexts, part >> SYMBOL_BITS), len(contexts) - 1)
        known = contexts[at] == part >> SYMBOL_BITS
        score[todo[known]] += weights[at[known]]
    else:
        score[todo] -= np.log(1 << SYMBOL_BITS)
    signs = int(((code & ((1 << SYMBOL_BITS) - 1)) == SIGN).sum())
    return float((signs * sign_cost() - score.sum()) / len(code))


_SPACES = " \t\n\x0b\x0c\r"
_FOUND = re.compile(r"[^\x20\x09-\x0D]")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside any window that occurs at least twice, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(window):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
        code ^= code >> np.uint64(29)
    _, at, times = np.unique(code, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[at] > 1)
    if not len(maybe):
        return 0
    first: dict[tuple[bytes, ...], int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in maybe.tolist():  # hashes may collide: the words decide
        key = tuple(words[i : i + window])
        if key in first:
            starts = (i,) if first[key] < 0 else (first[key], i)
            first[key] = -1
            for s in starts:
                covered[s] += 1
                covered[s + window] -= 1
        else:
            first[key] = i
    return int((np.cumsum(covered) > 0).sum())


def facts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if _FOUND.search(x)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _score(docs: DataFrame, models: list, with_others: bool) -> DataFrame:
    """Facts and log perplexity of the documents whose language has a model here; of others too if asked."""
    held = docs.sparkSession.sparkContext.broadcast({r["lang"]: unpack(r) for r in models})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for b in batches:
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                levels = held.value.get(lang)
                rows.append((*facts(text), log_perplexity(text, levels) if text and levels else None))
            columns = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]
            names = [p.split()[0] for p in FACTS.split(", ")] + ["log_perplexity"]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), b.column("lang"), *arrays], ["rid", "doc_id", "lang", *names])

    langs = [r["lang"] for r in models]
    known = F.col("lang").isin([x for x in langs if x is not None])
    if None in langs:
        known = known | F.col("lang").isNull()
    part = docs if with_others else docs.where(F.coalesce(known, F.lit(False)))
    return part.select("rid", "doc_id", "lang", "text").mapInArrow(run, f"rid long, doc_id long, lang string, {FACTS}, log_perplexity double")


def scored(docs: DataFrame) -> DataFrame:
    """Facts and log perplexity (null for empty texts) of each row of keyed documents, written once."""
    models = materialise(train(docs), "model")
    sizes = sorted(models.select("lang", "bytes").collect(), key=lambda r: (r["lang"] is None, r["lang"]))
    if sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES:
        return materialise(_score(docs, models.collect(), True), "scores")
    groups, room = [[]], BROADCAST_BYTES
    for r in sizes:
        if r["bytes"] > room and groups[-1]:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(r["lang"])
        room -= r["bytes"]
    parts = []
    for langs in groups:
        here = reduce(lambda x, y: x | y, [F.col("lang").eqNullSafe(F.lit(x).cast("string")) for x in langs])
        parts.append(materialise(_score(docs, models.where(here).collect(), False), "scores"))
    modelled = reduce(lambda x, y: x | y, [F.col("lang").eqNullSafe(F.lit(r["lang"]).cast("string")) for r in sizes])
    parts.append(materialise(_score(docs.where(~modelled), [], True), "scores"))
    return reduce(DataFrame.union, parts)


def judged(docs: DataFrame, upper: float = UPPER_BAND, lower: float = LOWER_BAND, least_spread: float = LEAST_SPREAD) -> DataFrame:
    """Facts, base_failed and kept of each row of ``docs`` (doc_id, text, lang).

    Null texts are empty; null languages are a language of their own. An empty text fails the base
    rules. Repeated rows are judged each. A document is kept if it passes the base rules and its
    perplexity lies within the bands of its language. An empty table gives an empty result.
    """
    return judge(keyed(docs.withColumn("lang", F.col("lang").cast("string")), keep=("lang",)), upper, lower, least_spread)


def judge(keyed_docs: DataFrame, upper: float = UPPER_BAND, lower: float = LOWER_BAND, least_spread: float = LEAST_SPREAD) -> DataFrame:
    rows = scored(keyed_docs)
    middle = rows.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    with_middle = rows.join(middle, rows.lang.eqNullSafe(middle.lang)).drop(middle.lang)
    away = F.abs(F.col("log_perplexity") - F.col("middle"))
    spread = with_middle.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx(away, 0.5, 10_000).alias("mad"))
    spread = spread.select(F.col("lang").alias("_lang"), "middle", F.greatest(1.4826 * F.col("mad"), F.lit(least_spread)).alias("spread"))
    out = rows.join(spread, rows.lang.eqNullSafe(spread._lang), "left").drop("_lang")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    above = F.col("log_perplexity") > F.col("middle") + upper * F.col("spread")
    below = F.col("log_perplexity") < F.col("middle") - lower * F.col("spread")
    return out.withColumn("base_failed", failed).withColumn("kept", F.coalesce(~failed & ~above & ~below, F.lit(False)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, all columns."""
    rows = keyed(packed(docs), keep=("rest",))
    good = judge(rows.select("rid", "doc_id", "text", F.col("rest.lang").cast("string").alias("lang")))
    return unpacked(rows.join(good.where("kept").select("rid"), "rid", "left_semi"), docs)
