"""Benchmark passages in documents, by a prefix-filtered set join of word shingles.

Items are cut into windows of ``WINDOW`` consecutive words; an item of fewer words is one
window of its own size. A window is a set of shingles (``SHINGLE`` words, or all of a shorter
window), each at its offset.

1. One scan of the documents emits the places whose shingle is one of the benchmark's, with
   the words around it; that narrow table is written.
2. Shingles are ordered by rarity, as counted over the documents. For complete containment
   the necessary prefix of a window is its rarest shingle alone: a text without it cannot
   hold the window, and a window with a shingle that no text holds occurs nowhere.
3. Places are joined with the windows whose prefix they show. The offset of the shingle fixes
   where the window would begin and end: both have to lie in the document (position and length
   bounds). What is left is verified, word by word, against the window-sized part.
4. Occurrences of a document are merged into hit words. Items of a window are replaced by the
   number of their set before the join, so a passage that many documents share with many
   items brings one row for each occurrence, and sets are opened once for each distinct
   combination, not for each document.

Windows that several items share are joined once. The benchmark's shingles and windows are
broadcast if their counted bytes are at most ``BROADCAST_BYTES``; beyond that, hashes of words
are shuffled instead, and a shingle that a third of all documents hold is split by adaptive
execution.

Defined cases: words are made by ``word_pattern`` after A-Z have been lower-cased; a null text,
an empty one and one of separators alone have no words; items without words have no windows;
a window across rows does not exist; rows that repeat an id are looked at each; items that
repeat an id count once; a null item id counts as no item, but its words are hit; further
columns are ignored, whatever their names; an empty benchmark hits nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import narrow, written

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Digits, a-z (A-Z before) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of the benchmark's shingles, or of its windows, that are broadcast, at most.
BROADCAST_BYTES = 32 << 20
#: Bytes of a shingle's hash in a table, and of a window besides its words.
TOKEN_BYTES, PREFIX_BYTES = 16, 160


def words_of(text: Column, word_pattern: str = WORD) -> Column:
    """The words of a text; null if the text is null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(word_pattern), F.lit(0))


def _token(words: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from place ``at``; equal hashes are verified later."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def item_windows(
    benchmark: DataFrame, window: int = WINDOW, word_pattern: str = WORD, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct windows (words joined by spaces, their number) with the ids of their items."""
    items = narrow(benchmark, item=id_col, text=text_col).select("item", words_of(F.col("text"), word_pattern).alias("words"))
    items = items.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    words = F.slice("words", F.col("at") + 1, F.lit(window))
    cut = starts.select("item", F.array_join(words, " ").alias("window"), F.size(words).alias("size"))
    return cut.groupBy("window", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))


def window_shingles(windows: DataFrame, size: int, shingle: int = SHINGLE) -> DataFrame:
    """window, size, offset and token of every shingle of the windows of ``size`` words."""
    length = min(shingle, size)
    cut = windows.where(F.col("size") == size).withColumn("words", F.split("window", " "))
    offsets = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - length))).alias("offset"))
    return offsets.select("window", "size", "offset", _token(F.col("words"), F.col("offset"), length).alias("token"))


def _tokens_at(words: Column, at: Column, n_words: Column, lengths: list[int]) -> Column:
    """The token of each length that begins at a place; null where the text ends before."""
    return F.array(*[F.when(at + size <= n_words, _token(words, at, size)) for size in lengths])


def _numbered(docs: DataFrame, word_pattern: str) -> DataFrame:
    words = words_of(F.col("text"), word_pattern).alias("words")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", words)
    return rows.select("row", "id", F.coalesce(F.greatest(F.size("words"), F.lit(0)), F.lit(0)).alias("n_words"), "words")


def _with_surroundings(places: DataFrame, reach: int) -> DataFrame:
    """Places with the words that a window may cover; ``token`` is null for a mere document."""
    begin = F.greatest(F.col("at") - reach, F.lit(0))
    around = F.slice("words", begin + 1, F.lit(2 * reach))
    return places.select(
        "row", "id", "n_words", "first", "at", "token",
        F.when(F.col("token").isNotNull(), begin).alias("begin"), F.when(F.col("token").isNotNull(), around).alias("around"),
    )


def _places(docs: DataFrame, tokens: DataFrame, lengths: list[int], window: int, word_pattern: str) -> DataFrame:
    """A row for each document (``first``) and one for each place that shows a token.

    One scan, as the tokens are broadcast: no word is shuffled.
    """
    at, made = F.col("at"), _tokens_at(F.col("words"), F.col("at"), F.col("n_words"), lengths)
    place = _numbered(docs, word_pattern).select("*", F.posexplode_outer("words").alias("at", "_word")).drop("_word")
    if len(lengths) > 1:
        place = place.select("*", F.posexplode(made).alias("which", "made"))
    else:
        place = place.select("*", F.lit(0).alias("which"), made[0].alias("made"))
    seen = place.join(F.broadcast(tokens), F.col("made") == F.col("token"), "left")
    first = (F.coalesce(at, F.lit(0)) == 0) & (F.col("which") == 0)
    seen = seen.withColumn("first", first).where(F.col("token").isNotNull() | F.col("first"))
    return _with_surroundings(seen, window)


def _places_of_many(docs: DataFrame, tokens: DataFrame, lengths: list[int], window: int, word_pattern: str) -> DataFrame:
    """The same for tokens too many to broadcast: hashes of the words meet them by a shuffle.

    Only document number, place and hash are shuffled for the join, which adaptive execution
    splits at a hot hash; the words of a document meet its places once.
    """
    rows = written(_numbered(docs, word_pattern))
    made = _tokens_at(F.col("words"), F.col("at"), F.col("n_words"), lengths)
    place = rows.select("row", "n_words", "words", F.posexplode("words").alias("at", "_word"))
    place = place.select("row", "at", F.explode(made).alias("token")).where(F.col("token").isNotNull())
    seen = place.join(tokens, "token").groupBy("row").agg(F.collect_list(F.struct("at", "token")).alias("seen"))
    whole = rows.join(seen, "row", "left").select("*", F.posexplode_outer("seen").alias("turn", "one"))
    return _with_surroundings(
        whole.select("row", "id", "n_words", "words", (F.coalesce("turn", F.lit(0)) == 0).alias("first"), "one.at", "one.token"), window
    )


def rarest(shingles: DataFrame, places: DataFrame) -> DataFrame:
    """window, size, offset, token: of each window that may occur, its rarest shingle."""
    counts = places.where(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("n"))
    known = shingles.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_rarity = F.struct("n", "offset", "token")
    best = known.groupBy("window", "size").agg(F.min(by_rarity).alias("rare"))
    return best.where(F.col("rare.n") > 0).select("window", "size", "rare.offset", "rare.token")


def occurrences(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """Verified occurrences: row, start, size and the columns that ``prefix`` carries."""
    pairs = places.where(F.col("token").isNotNull()).join(prefix, "token")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    part = F.slice("around", start - F.col("begin") + 1, F.col("size"))
    verified = pairs.where(inside).where(F.array_join(part, " ") == F.col("window"))
    return verified.select("row", start.alias("start"), "size", "item_set")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    word_pattern: str = WORD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Of every document: id, n_words, hit spans (start, end), and the ids of the items in it."""
    windows = written(item_windows(benchmark, window, word_pattern, item_col, item_text_col))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window``
    if not sizes:  # a window of no item: everything below stays empty
        sizes = [window]
    lengths = sorted({min(shingle, s) for s in sizes}, reverse=True)
    parts = [window_shingles(windows, s, shingle) for s in sizes]
    shingles = parts[0]
    for part in parts[1:]:
        shingles = shingles.unionByName(part)
    shingles = written(shingles)
    tokens = written(shingles.select("token").distinct())
    find = _places if tokens.count() * TOKEN_BYTES <= BROADCAST_BYTES else _places_of_many
    places = written(find(narrow(docs, id=id_col, text=text_col), tokens, lengths, window, word_pattern))

    # windows with the same items share the number of their set
    sets = windows.select(F.sha2(F.to_json(F.struct("items")), 256).alias("item_set"), "items", "window")
    prefix = rarest(shingles, places).join(sets.select("window", "item_set"), "window")
    prefix = written(prefix)
    size = prefix.agg(F.sum(F.octet_length("window") + PREFIX_BYTES)).first()[0] or 0
    found = occurrences(places, F.broadcast(prefix) if size <= BROADCAST_BYTES else prefix)

    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    hits = found.groupBy("row").agg(
        F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("item_set")).alias("sets")
    )
    hits = written(hits.select("row", _merged(F.col("spans")).alias("spans"), F.sha2(F.array_join("sets", ","), 256).alias("mix"), "sets"))
    # each combination of sets is opened once
    mixes = hits.dropDuplicates(["mix"]).select("mix", F.explode("sets").alias("item_set"))
    of_set = sets.select("item_set", "items").dropDuplicates(["item_set"])
    items = mixes.join(of_set, "item_set").groupBy("mix").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    done = hits.select("row", "spans", "mix").join(items, "mix").select("row", "spans", "items")
    every = places.where("first").select("row", "id", "n_words")
    return every.join(done, "row", "left").select(
        "id", "n_words",
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"),
    )


_SPANS = "array<struct<start:int,end:int>>"


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch united."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < span["start"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        )

    return F.aggregate(spans, F.array().cast(_SPANS), add)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
