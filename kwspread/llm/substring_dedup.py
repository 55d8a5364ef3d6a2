"""Operator 1: removal of word windows that occur more than once, by FM-indexes.

Sharding by content. In every window of WINDOW words the least hash of its GRAM-word
runs is the window's anchor (the last one on ties), so equal windows have equal anchors
wherever they stand. Consecutive windows of a document with one anchor form a segment;
every window lies in exactly one segment, and all its copies in segments of the same
anchor. So:

1. `anchor_rows`: each document gives one narrow row per segment (position, number of
   windows, hashes of anchor and segment), about one per 15 words. A segment that a
   document holds several times (a line or word pair repeated on end, where ties move the
   anchor every few words) is one row with all its positions. No text moves.
2. Anchors that occur once in the corpus are dropped by a count. Where an anchor occurs
   with one content only, that content is repeated as a whole: all its windows are
   reported without a look at any text (the inside of a passage or document copied by a
   third of the rows). Of the other segments one of each content is chosen to bring its
   text, and their number is its weight.
3. Chosen segments are dealt into shards by anchor. A window holds the anchor and SIDE
   words before it or SIDE words after it, so a segment can only share a window with one
   that has an equal side. The others are left out (their windows repeat if they weigh two
   or more). Of the rest a shard builds one compressed FM-index and streams them through
   it: backward search gives the matching statistics, and positions whose match of weight
   two or more spans a whole window are reported as a bit mask per segment. An anchor with
   more than HOT segments (the edges of a very common passage) is cut into single windows,
   which are dealt by their own content instead.
4. Masks go back to the segments' documents, and covered words are removed there.

Defined results: a null or empty text has no words; texts shorter than a window are kept
whole; windows are judged on the input, so all copies of a repeated window go, those
inside one document and overlapping ones included; rows that repeat or lack a doc_id are
told apart by their text; repeated rows repeat each other's windows; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import Slots, give_back, materialise, split_words, text_slices, worker_cache
from kwspread.llm.fm_index import FMIndex, matching_statistics
from kwspread.operators.common import bounded_lookup

WINDOW = 35
GRAM = 6
#: Windows that can share one anchor.
SPAN = WINDOW - GRAM + 1
#: Words beside the anchor that one side at least of a window has.
SIDE = (WINDOW - GRAM) // 2
SEGMENTS_PER_SHARD = 12_000
HOT = 40_000
MAX_KNOWN = 400_000

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
_ONE = np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class WordHashes:
    """64-bit hashes of the words of texts; a worker keeps the words it has met."""

    def __init__(self) -> None:
        self.slots, self.hashes = Slots(), np.empty(0, np.uint64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > MAX_KNOWN:
            self.__init__()
        words, counts = split_words(texts)
        at, new = self.slots.numbered(words)
        if new:
            told = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate((self.hashes, told))
        return self.hashes[at], counts


def segments(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first word, windows, anchor hash and content hash of all segments."""
    none = np.empty(0, np.int64)
    n = len(hashes)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = _mix(grams * _P + hashes[k : k + len(grams)])
    # Least gram (the last on ties) of every SPAN consecutive ones, by doubling.
    value, where, width = grams, np.arange(len(grams)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left, right = value[:-step], value[step:]
        keep = left < right
        value, where = np.where(keep, left, right), np.where(keep, where[:-step], where[step:])
        width += step
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = where[start]
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(first)
    windows = np.diff(np.append(heads, len(start)))
    begin = start[heads]
    power = np.multiply.accumulate(np.concatenate(([_ONE], np.full(n, _Q, np.uint64))))
    undo = np.multiply.accumulate(np.concatenate(([_ONE], np.full(n, _inverse(_Q), np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
    end = begin + windows + WINDOW - 1
    content = _mix((total[end] - total[begin]) * undo[begin] + windows.astype(np.uint64) * _P)
    origin = (np.cumsum(counts) - counts)[text[begin]]
    return text[begin], begin - origin, windows, grams[anchor[heads]], content


def _word_hashes() -> WordHashes:
    return worker_cache("word hashes", WordHashes)


#: `at` holds 64 * first word + windows; `more` the same of a segment's further places in
#: the document, null if there are none.
ANCHORS = "row long, at long, more array<long>, anchor long, content long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(map(text_slices, batches)):
        text, first, windows, anchor, content = segments(*_word_hashes().of(batch.column("text")))
        # Equal segments of a text side by side, in order of place.
        order = np.lexsort((first, content, anchor, text))
        text, anchor, content, at = text[order], anchor[order], content[order], (first * 64 + windows)[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(order))) - 1
        ends = np.concatenate(([0], np.cumsum(size)))
        more = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(at[~new], pa.int64()), mask=pa.array(size == 0, pa.bool_())
        )
        row = batch.column("row").to_numpy()[text[heads]]
        columns = [pa.array(c, pa.int64()) for c in (row, at[heads], anchor[heads].view(np.int64), content[heads].view(np.int64))]
        yield pa.RecordBatch.from_arrays([*columns[:2], more, *columns[2:]], ["row", "at", "more", "anchor", "content"])


def keyed_rows(docs: DataFrame, name: str) -> DataFrame:
    """Add a row's key: the doc_id where these are whole and unique, else a hash with the text."""
    told = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.col("doc_id").isNull())).first()
    plain = told[0] is None or (told[0] == 1 and not told[1])
    return docs.withColumn(name, F.col("doc_id").cast("long") if plain else F.xxhash64("doc_id", "text"))


def _sides(words: list[bytes], anchor_at: int) -> tuple[int, int]:
    """Hashes of the words before the anchor and after it, the anchor included; 0 where
    the text ends before."""
    left = words[anchor_at - SIDE : anchor_at + GRAM] if anchor_at >= SIDE else None
    right = words[anchor_at : anchor_at + GRAM + SIDE]
    return tuple(
        xxhash.xxh3_64_intdigest(b" ".join(side)) >> 1 if side and len(side) == SIDE + GRAM else 0 for side in (left, right)
    )


def _word_hash(known: dict[bytes, int], word: bytes) -> int:
    if len(known) > MAX_KNOWN:
        known.clear()
    if (h := known.get(word)) is None:
        h = known[word] = xxhash.xxh3_64_intdigest(word)
    return h


def _anchor_places(hashes: np.ndarray) -> np.ndarray:
    """Where the anchors of windows (a row of word hashes each) stand: the last least run
    of GRAM words."""
    grams = np.zeros((len(hashes), SPAN), np.uint64)
    for k in range(GRAM):
        grams = _mix(grams * _P + hashes[:, k : k + SPAN])
    return SPAN - 1 - np.argmin(grams[:, ::-1], axis=1)


def _segment_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the chosen segments of each document, and their anchors' sides."""
    for batch in chain.from_iterable(map(text_slices, batches)):
        known = worker_cache("segment words", dict)
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for text, chosen in zip(batch.column("text").to_pylist(), batch.column("chosen").to_pylist(), strict=True):
            words = text.encode().split()
            at = [divmod(s["at"], 64) for s in chosen]
            flat = [_word_hash(known, w) for first, _ in at for w in words[first : first + WINDOW]]
            places = _anchor_places(np.array(flat, np.uint64).reshape(-1, WINDOW))
            for s, (first, windows), place in zip(chosen, at, places.tolist(), strict=True):
                sides = _sides(words, first + place)
                own = b" ".join(words[first : first + windows + WINDOW - 1])
                for column, x in zip(out, (s["anchor"], s["content"], s["weight"], own, *sides), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["anchor", "content", "weight", "words", "left", "right"]
        )


SEGMENTS = "anchor long, content long, weight long, words binary"
SIDED = SEGMENTS + ", left long, right long"


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut segments into their windows, keyed by the windows' own content."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for a, c, w, text in zip(*(part.column(k).to_pylist() for k in ("anchor", "content", "weight", "words")), strict=True):
                words = text.split()
                for k in range(len(words) - WINDOW + 1):
                    own = b" ".join(words[k : k + WINDOW])
                    digest = xxhash.xxh3_128_digest(own)
                    rows.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), w, own, a, c, k))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = ["anchor", "content", "weight", "words", "of_anchor", "of_content", "bit"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def _search_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Masks of the windows of segments that weigh two or more among these."""
    words, counts = split_words(pa.array(rows["words"].to_list(), pa.binary()).cast(pa.string()))
    numbers = words.indices.to_numpy().astype(np.int64)
    index = FMIndex(numbers, counts, rows["weight"].to_numpy(), len(words.dictionary))
    length = matching_statistics(index, numbers, counts, least=2)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(numbers)) - np.repeat(starts, counts)
    bits = np.where(length >= WINDOW, 1 << np.minimum(place, 62), 0)
    mask = np.add.reduceat(bits, starts) if len(starts) else bits
    return pd.DataFrame({"anchor": rows["anchor"], "content": rows["content"], "mask": mask})[mask > 0]


def _search_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["anchor", "content"], ignore_index=True)
    if "left" not in rows:
        return _search_rows(rows)
    shared = np.zeros(len(rows), bool)
    for side in ("left", "right"):
        shared |= (rows[side] != 0) & rows.duplicated(["anchor", side], keep=False)
    alone = rows[~shared & (rows["weight"] > 1)]
    windows = alone["words"].map(lambda w: w.count(b" ") + 2 - WINDOW).astype("int64")
    whole = pd.DataFrame({"anchor": alone["anchor"], "content": alone["content"], "mask": np.left_shift(1, windows) - 1})
    found = [whole.astype("int64"), *([_search_rows(rows[shared])] if shared.any() else [])]
    give_back()
    return pd.concat(found)


MASKS = "anchor long, content long, mask long"


def _search(found: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    dealt = found.select("*", shard)
    return dealt.groupBy("shard").applyInPandas(_search_shard, MASKS)


def repeated_segments(docs: DataFrame) -> DataFrame:
    """repeat_row, repeat_hits (places and mask of segments) of the documents with repeated
    windows; `docs` needs repeat_row and text."""
    texts = docs.select(F.col("repeat_row").alias("row"), "text")
    every = materialise(texts.mapInArrow(_anchor_rows, ANCHORS), "anchors")
    places = F.sum(F.coalesce(F.array_size("more"), F.lit(0)) + 1)
    again = every.groupBy("anchor").agg(places.alias("n"), (F.min("content") != F.max("content")).alias("several"))
    # Written first, so both sides of the join are plain shuffles that can be split where
    # an anchor is hot.
    again = materialise(again.where("n > 1").select("anchor", "several"), "anchor-counts")
    some = materialise(every.join(again, "anchor"), "repeated-anchors")
    alike = some.where("NOT several").select("row", "at", "more", F.expr("shiftleft(1L, cast(at % 64 as int)) - 1").alias("mask"))
    some = some.where("several").drop("several")
    mark = F.xxhash64("row", "at")
    chosen = some.groupBy("anchor", "content").agg(places.alias("weight"), F.min(mark).alias("mark"))
    chosen = some.drop("more").withColumn("mark", mark).join(chosen, ["anchor", "content", "mark"])
    # Equal rows repeat their segments; one text of each is enough.
    chosen = chosen.dropDuplicates(["anchor", "content"])
    lists = chosen.groupBy("row").agg(F.collect_list(F.struct("at", "anchor", "content", "weight")).alias("chosen"))
    found = texts.join(lists, "row").mapInArrow(_segment_texts, SIDED).dropDuplicates(["anchor", "content"])
    found = materialise(found, "segments")
    sizes = found.groupBy("anchor").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    shards = max(1, (total[0] or 0) // SEGMENTS_PER_SHARD)
    if (total[1] or 0) <= HOT:
        masks = _search(found, shards)
    else:
        hot = bounded_lookup(sizes.where(F.col("n") > HOT).select("anchor"))
        masks = _search(found.join(hot, "anchor", "left_anti"), shards)
        names = SEGMENTS + ", of_anchor long, of_content long, bit long"
        single = found.drop("left", "right").join(hot, "anchor").mapInArrow(_single_windows, names)
        single = materialise(single, "windows")
        merged = single.groupBy("anchor", "content").agg(F.sum("weight").alias("weight"), F.min("words").alias("words"))
        hits = _search(materialise(merged, "window-classes"), shards).select("anchor", "content")
        bits = single.join(hits, ["anchor", "content"]).select("of_anchor", "of_content", "bit")
        own = F.sum(F.expr("shiftleft(1L, cast(bit as int))"))
        masks = masks.union(bits.groupBy("of_anchor", "of_content").agg(own))
    masks = materialise(masks, "masks")
    hit = some.join(masks, ["anchor", "content"]).select("row", "at", "more", "mask").union(alike).distinct()
    return hit.groupBy(F.col("row").alias("repeat_row")).agg(F.collect_list(F.struct("at", "more", "mask")).alias("repeat_hits"))


def covered_words(n: int, hits: list[dict] | None) -> np.ndarray:
    """Which of n words lie in a reported window."""
    edge = np.zeros(n + 1, np.int64)
    for hit in hits or ():
        first, windows = divmod(np.array([hit["at"], *(hit["more"] or ())], np.int64), 64)
        starts = np.add.outer(first, np.flatnonzero(hit["mask"] >> np.arange(windows[0]) & 1)).ravel()
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't use."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _judged(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with the repeated windows of each, and the name of that column."""
    key, hits = _free(docs, "repeat_row"), _free(docs, "repeat_hits")
    keyed = keyed_rows(docs, key)
    found = repeated_segments(keyed.select(F.col(key).alias("repeat_row"), "text"))
    found = found.withColumnsRenamed({"repeat_row": key, "repeat_hits": hits})
    return keyed.join(found, key, "left").select(*docs.columns, hits), hits


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The same rows; texts with repeated windows become their other words, joined by one
    space. Columns other than text are kept."""
    columns = docs.columns
    judged, name = _judged(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            texts = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
                if hits:
                    words = text.encode().split()
                    gone = covered_words(len(words), hits)
                    text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    return judged.mapInArrow(run, docs.schema)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            out: tuple[list, ...] = ([], [], [])
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("repeat_hits").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept = words
                if hits:
                    gone = covered_words(len(words), hits)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _judged(docs.select("doc_id", "text"))[0].mapInArrow(run, DIGEST)
