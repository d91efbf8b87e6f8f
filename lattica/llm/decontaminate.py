"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

Each benchmark item is cut into windows of consecutive words, and each window into word shingles.
The shingles of a window are ordered by rarity in the documents.  Exact containment asks for all of
them, so the necessary prefix is the rarest one: documents are joined on that alone, a candidate must
leave room for the window's length on both sides of the shingle's place, and what remains is verified
word by word against the document.  Up to a counted number of windows they are sent to every task;
more are joined by shuffling hashes and places alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import settle, words_of

#: Windows (of ten words and a few numbers each) up to which the item side may be broadcast.
BROADCAST_WINDOWS = 200_000


def _shingles(words: Column, size: int) -> Column:
    """Hash of the shingle at every place of ``words``; empty if it has fewer."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)], F.lit(size)))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<long>"))


def item_windows(items: DataFrame, width: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window array<string>): every run of ``width`` words, or all words of a shorter item; none for an item without words."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, width))).alias("window")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """Add to each window its rarest shingle over all documents: (item_id, window, hash, place, size). Ties go to the first place."""
    size = F.least(F.lit(shingle), F.size("window"))
    by_size = reduce(lambda c, s: c.when(size == s, _shingles(F.col("window"), s)), range(1, shingle), F)  # type: ignore[arg-type]
    hashes = by_size.otherwise(_shingles(F.col("window"), shingle))
    each = settle(windows.withColumn("size", size).select("*", F.posexplode(hashes).alias("place", "hash")))
    wanted = each.select("hash").distinct()
    sizes = [r.size for r in each.select("size").distinct().collect()]  # at most `shingle` rows
    words = docs.select(words_of(F.col(text)).alias("w"))
    seen = words.select(F.explode(F.concat(*[_shingles(F.col("w"), s) for s in sizes])).alias("hash")) if sizes else wanted.limit(0)
    small = each.count() <= BROADCAST_WINDOWS * 10
    counts = seen.join(F.broadcast(wanted) if small else wanted, "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("seen"))
    ranked = each.join(counts, "hash", "left").groupBy("item_id", "window", "size").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("place"), F.col("hash"))).alias("rarest"))
    return ranked.select("item_id", "window", "size", "rarest.hash", "rarest.place")


def _places(rows: DataFrame, sizes: list[int]) -> tuple[DataFrame, Column]:
    """One row for each shingle of the given sizes (``col``, its hash), and the place where it starts, given the column ``size``."""
    before, ahead = F.lit(0), F.lit(0)  # entries in front of those of a shingle size
    for s in sizes:
        before = F.when(F.col("size") == s, ahead).otherwise(before)
        ahead = ahead + F.greatest(F.lit(0), F.col("n_words") - (s - 1))
    each = [_shingles(F.col("w"), s) for s in sizes] or [F.array().cast("array<long>")]
    return rows.select("*", F.posexplode(F.concat(*each))), F.col("pos") - before


def _in_place(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, start, length, item_id) of all occurrences; the windows, counted before, go to every task."""
    places, at = _places(rows, sizes)
    start, length = at - F.col("place"), F.size("window")
    fits = (start >= 0) & (start + length <= F.col("n_words")) & (F.slice("w", F.greatest(F.lit(1), start + 1), length) == F.col("window"))
    return places.join(F.broadcast(windows), (F.col("col") == F.col("hash")) & fits).select("key", start.alias("start"), length.alias("length"), "item_id")


def _by_shuffle(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same with any number of windows: only places and hashes meet the windows; words are fetched afterwards, for what is left."""
    places, at = _places(rows, sizes)
    found = places.select("key", "n_words", "pos", "col").join(windows, F.col("col") == F.col("hash"))
    left = found.select("key", "n_words", (at - F.col("place")).alias("start"), F.size("window").alias("length"), "window", "item_id")
    left = settle(left.where("start >= 0 and start + length <= n_words").drop("n_words").distinct())
    words = rows.join(left.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("w").alias("w"))
    return left.join(words, "key").where(F.slice("w", F.col("start") + 1, F.col("length")) == F.col("window")).select("key", "start", "length", "item_id")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array of item ids), hits (array of struct(start, length)).

    A word is hit if it lies inside any occurrence of any window.  Null and empty texts have no words
    and no hits; repeated rows and null doc_ids get a row each; items without words have no windows, an
    item with a null id hits words but is not listed;
    an empty benchmark hits nothing; other columns are not read.  A long document is one row of
    work, in which every window costs one comparison.  Hits are found once for each text and joined
    to the documents that have it.
    """
    windows = settle(prefixes(item_windows(items, width), docs, shingle, text))
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most `shingle` rows
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.md5(body.cast("binary"))).alias("key"), words_of(body).alias("w")).withColumn("n_words", F.size("w"))
    search = _in_place if windows.count() <= broadcast else _by_shuffle
    found = search(rows, windows, sizes)
    by_text = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end")),
        lambda a: a["n"],
    )
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("key"), F.size(words_of(body)).cast("long").alias("n_words"))
    none = F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits")
    hit = by_text.select("key", covered.cast("long").alias("n_hit"), "items", "hits")
    return counted.join(hit, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), none)


def cut_hits(text: Column, hits: Column) -> Column:
    """The words of a text without those that were hit, joined by blanks."""
    words = words_of(text)
    kept = F.filter(F.transform(words, lambda w, i: F.when(~F.exists(hits, lambda h: (h["start"] <= i) & (i < h["start"] + h["length"])), w)), lambda w: w.isNotNull())
    return F.array_join(kept, " ")
