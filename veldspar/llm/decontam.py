"""Benchmark passages in documents, by a prefix-filtered set join on word shingles. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veldspar.llm._columns import free
from veldspar.storage import stage

#: Words of a shingle, the tokens that are joined.
SHINGLE = 3
#: A document holds an item if it has this share of its words, in windows of SHINGLE words in one stretch: a wrong word
#: costs at most SHINGLE of them. An item of so few words must be whole.
SHARE, WHOLE = 2 / 3, 8
#: Rows of a table that may be broadcast, a few numbers each; beyond, the join is a shuffled one.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Lower-case words of a whole text, A-Z alone in lower case; none for a null text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(ascii_, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _GAP), "")


def shingles(of: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of ``n`` words, in order, of an array of so many at least."""
    return F.transform(F.sequence(F.lit(0), F.size(of) - n), lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(n)]))


def windows(items: DataFrame, size: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, length): each run of ``size`` item words; a shorter item, unless empty, is one window."""
    split = items.select(F.col(item_col).alias("item"), words(text_col).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    out = split.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), size).alias("window"))
    return out.distinct().withColumn("length", F.size("window"))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a table that has been counted and is within BROADCAST_ROWS."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, words, n_words), staged: a number for each row, so that rows with one id, or none, stay apart."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(text_col).alias("words"))
    return stage(split.withColumn("n_words", F.size("words")), "words")


def _places(split: DataFrame, items: DataFrame, size: int, item_col: str, item_text: str, shingle: int) -> DataFrame:
    """(row, item, start, length, window): where an item's windows may stand. Of a window's shingles the rarest in all
    documents has been found there, and the window has room. A window no longer than a shingle is that shingle."""
    wins = stage(windows(items, size, item_col, item_text).withColumn("n", F.least("length", F.lit(shingle))), "windows")
    lengths = sorted(r.n for r in wins.select("n").distinct().collect()) or [shingle]  # at most `shingle` different ones
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    tokens = stage(union([wins.where(F.col("n") == n).select("item", "window", "length", "n", F.posexplode(shingles(F.col("window"), n)).alias("offset", "hash")) for n in lengths]), "tokens")
    # numbers alone are copied with each shingle: the words stay below
    spread = union([split.where(F.col("n_words") >= n).select("row", "n_words", F.posexplode(shingles(F.col("words"), n)).alias("at", "hash")).withColumn("_n", F.lit(n)) for n in lengths])
    seen = stage(spread.join(_small(tokens.select("hash").distinct()), "hash"), "seen")
    if size <= shingle:
        prefix = tokens
    else:
        rarity = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("seen"))
        ranked = tokens.join(rarity, "hash", "left").groupBy("item", "window", "length", "n").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "hash", "offset")).alias("rarest"))
        prefix = stage(ranked.where("rarest.seen > 0").select("item", "window", "length", "n", F.col("rarest.hash").alias("hash"), F.col("rarest.offset").alias("offset")), "prefix")
    start = F.col("at") - F.col("offset")
    fits = (F.col("n") == F.col("_n")) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    return seen.join(_small(prefix), "hash").where(fits).select("row", "item", start.alias("start"), "length", "window")


def contained_windows(docs: DataFrame, items: DataFrame, size: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Return for each row of ``docs``: id_col, n_words, hits; hits lists (item, start, length, window) for every place
    where an item's window of ``size`` words stands in the document, whole and in order; window is a hash of its words.

    A set join with full containment: of a window's shingles, ordered by how rare they are in all documents, the
    necessary prefix is the rarest one alone. So documents are joined on those only; the shingle's place in the
    window gives the place in the document (positional bound), which must leave room for the whole window
    (length bound); then the words are compared. Items of fewer words than a shingle have one shingle of all
    their words, looked for among the document's runs of that many words.

    A document's words are exploded to numbers alone, once; its word array moves only if it has a candidate, and
    then once. Null and empty documents have no words and no hits; null and empty items have no windows. Rows with
    one id, or a null one, are rows of their own. Items with one id are one item. Columns but those named aren't
    read. Empty tables give no rows, or no hits.
    """
    split = numbered(docs, id_col, text_col)
    place = F.struct("item", "start", "length", "window")
    found = stage(_places(split, items, size, item_col, item_text, shingle).groupBy("row").agg(F.collect_set(place).alias("places")), "places")
    held = split.select("row", "words").join(_small(found.select("row")), "row", "left_semi").join(found, "row")
    same = F.filter("places", lambda p: F.slice("words", p["start"] + 1, p["length"]) == p["window"])
    hits = held.select("row", F.transform(same, lambda p: F.struct(p["item"].alias("item"), p["start"].alias("start"), p["length"].alias("length"), F.xxhash64(p["window"]).alias("window"))).alias("hits"))
    out = split.select("row", "id", F.col("n_words").cast("long").alias("n_words")).join(hits, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))


def hit_words(hits: Column) -> Column:
    """How many words the hits cover."""
    each = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(each)))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = SHARE, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item, containment): documents with a stretch as long as the item whose windows of ``size`` words cover
    at least ``threshold`` of the item's words; containment is the largest such share. An item of WHOLE words or
    fewer must be covered whole.

    A stretch takes the windows that lie in as many words as the item has. What they cover is counted in the item
    and in the stretch and the lesser counts, so that one window that repeats in either isn't a passage. Hits are
    dealt to overlapping pieces of twice that length, so each stretch lies whole in one of them; only pieces with
    hits enough are then looked through exactly, a stretch from each of their hits. What is held is bounded by the
    item's length. A window's equality is that of a 64-bit hash of its words. Nulls and repeated ids are as in
    ``contained_windows``, but rows with one id are reported once.
    """
    split = numbered(docs, id_col, text_col)
    found = _contained(split, items, threshold, size, item_col, item_text)
    return found.join(split.select("row", "id"), "row").groupBy(F.col("id").alias(id_col), "item").agg(F.max("containment").alias("containment"))


def _contained(rows: DataFrame, items: DataFrame, threshold: float, size: int, item_col: str, item_text: str) -> DataFrame:
    """(row, item, containment) for (row, words, n_words)."""
    split = items.select(F.col(item_col).alias("item"), words(item_text).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    placed = split.select("item", "words", F.explode(starts).alias("at")).select("item", F.xxhash64(F.slice("words", F.col("at") + 1, size)).alias("window"), "at")
    width = split.groupBy("item").agg(F.max(F.size("words")).alias("width"))
    places = stage(placed.groupBy("item", "window").agg(F.sort_array(F.collect_set("at")).alias("places")).join(width, "item"), "item-places")
    found = _places(rows, items, size, item_col, item_text, size).select("row", "item", "start", "length", F.xxhash64("window").alias("window"))
    hits = found.join(_small(places), ["item", "window"])
    turn = F.floor(F.col("start") / F.col("width"))
    pieces = hits.withColumn("piece", F.explode(F.array(turn, turn - 1))).groupBy("row", "item", "width", "piece").agg(F.sort_array(F.collect_set(F.struct("start", "length", "places"))).alias("hits"))
    share = F.when(F.col("width") > WHOLE, F.lit(threshold)).otherwise(1.0)
    within = lambda h: F.filter("hits", lambda x: (x["start"] >= h["start"]) & (x["start"] + x["length"] <= h["start"] + F.col("width")))
    in_item = lambda hs: hit_words(F.flatten(F.transform(hs, lambda x: F.transform(x["places"], lambda p: F.struct(p.alias("start"), x["length"].alias("length"))))))
    held = F.array_max(F.transform("hits", lambda h: F.least(in_item(within(h)), hit_words(within(h)))))
    enough = pieces.where(F.size("hits") * size >= F.col("width") * share)
    best = enough.withColumn("containment", held / F.col("width")).where(F.col("containment") >= share)
    return best.groupBy("row", "item").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = SHARE, size: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows that hold an item, whatever their id; null and empty texts stay."""
    name = free("row", docs)
    kept = stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    split = stage(kept.select(F.col(name).alias("row"), words(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words")), "words")
    found = _contained(split, items, threshold, size, item_col, item_text).select(F.col("row").alias(name)).distinct()
    return kept.join(found, name, "left_anti").select(*docs.columns)
