"""Removing repeated word passages with sharded Aho-Corasick automata.

A window of 50 words is removed where the same words also start in a document
with a smaller doc_id.  The steps:

1. passages.py proposes phrases of eight words that recur, by hash, at anchors
   that every window picks by its content;
2. a phrase is confirmed if at least two different texts hold the same words;
3. the different texts are dealt into shards of a bounded size, and each shard
   gets the confirmed phrases of its texts.  It compiles them into Aho-Corasick
   automata of a bounded number of phrases and streams all its texts through
   them.  The hits, exact strings, are all that is known of the texts from here
   on: every window takes the hit in it whose phrase has the least hash;
4. windows around the same phrase are compared (passages.py).

A text without a proposed phrase is in no shard, as no automaton could hit it.

Defined results: a null text has no words; words keep their case and marks;
fewer than 50 words: nothing is removed; a null doc_id is later than all others;
a doc_id of 2**63 - 1 counts, and returns, as null; repeated doc_ids do not
remove each other's words, as none is smaller; an empty table gives an empty
table.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, passages
from .common import cut, discard, forget, spread_join, stored, word_array


class Words(passages.Unit):
    def __init__(self, window: int = 50, gram: int = 8):
        self.window, self.gram, self.within = window, gram, False

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return hashing.word_hashes(data, offsets)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Phrases between single spaces, so that only whole words match."""
    found = ahocorasick.Automaton()
    for number, phrase in enumerate(phrases):
        found.add_word(f" {phrase} ", (number, len(phrase)))
    found.make_automaton()
    return found


def located(texts: list[list[str]], phrases: list[str], most: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number, phrase) of every occurrence.  An automaton holds at most so many phrases; all texts stream past each."""
    lines = [f" {' '.join(words)} " for words in texts]
    starts = [1 + np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))[:-1] for words in texts]
    found: list[np.ndarray] = [np.empty((0, 3), np.int64)]
    for lo in range(0, len(phrases), most):
        shard = automaton(phrases[lo : lo + most])
        for number, line in enumerate(lines):
            hits = np.array([(end - length, phrase + lo) for end, (phrase, length) in shard.iter(line)], np.int64).reshape(-1, 2)
            word = np.searchsorted(starts[number], hits[:, 0])
            found.append(np.column_stack((np.full(len(hits), number), word, hits[:, 1])))
    return tuple(np.concatenate(found).T)


#: distinct phrases or segments that a task holds at once
HELD = 100_000
#: bytes of texts in a shard; it follows that its phrases are bounded, too
SHARD = 2 << 20


def confirmed_phrases(texts: DataFrame, unit: Words) -> DataFrame:
    """h, phrase: proposed phrases whose words at least two different texts hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}  # phrase -> hash, texts, the last of them

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v in seen.values()], pa.int64()), pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64())], ["h", "phrase", "n"])

        number = 0
        for batch in batches:
            grams = batch.column("grams")
            for lo, hi, data, starts, ends, at, (text, q, _, _, h) in passages.anchored(batch, unit):
                raw, keep = data.tobytes(), np.zeros(len(h), bool)
                ends_of = np.searchsorted(text, np.arange(hi - lo + 1))
                for i, (a, b) in enumerate(zip(ends_of[:-1], ends_of[1:], strict=True)):
                    keep[a:b] = np.isin(h[a:b], np.asarray(grams[lo + i].values).view(np.uint64))
                for t, p, g in zip(text[keep].tolist(), q[keep].tolist(), hashing.signed(h[keep]).tolist(), strict=True):
                    phrase = b" ".join(raw[s:e] for s, e in zip(starts[p : p + unit.gram], ends[p : p + unit.gram], strict=True)).decode()
                    known = seen.setdefault(phrase, [g, 0, -1])
                    if known[2] != number + lo + t:
                        known[1:] = known[1] + 1, number + lo + t
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
            number += batch.num_rows
        yield out()

    counts = texts.mapInArrow(rows, "h bigint, phrase string, n bigint")
    return counts.groupBy("h", "phrase").agg(F.sum("n").alias("n")).where("n > 1").select("h", "phrase")


def sharded(texts: DataFrame, phrases: DataFrame, unit: Words) -> DataFrame:
    """shard, kind (p before t), and of a phrase h, phrase, of a text did, tk, text; the rows of a shard follow each other."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = texts.withColumn("shard", F.pmod("tk", F.lit(max(1, -(-size // SHARD)))))
    # a phrase costs one row a shard, however many texts hold it
    wanted = texts.select("shard", F.explode("grams").alias("h")).distinct().join(phrases, "h")
    none = F.lit(None).cast("long")
    rows = wanted.select("shard", F.lit("p").alias("kind"), "h", F.col("phrase").alias("text"), none.alias("did"), none.alias("tk"))
    rows = rows.unionByName(texts.select("shard", F.lit("t").alias("kind"), none.alias("h"), "text", "did", "tk"))
    return rows.repartition(passages.parts_of(texts), "shard").sortWithinPartitions("shard", "kind")


def occurrences(shards: DataFrame, unit: Words) -> DataFrame:
    """kind o: one row per text and segment, with all its places; kind s: one row per task and distinct segment."""
    schema = "kind string, did bigint, tk bigint, lo bigint, n int, h bigint, ih1 bigint, ih2 bigint, segment string, los array<bigint>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[tuple[int, int], list] = {}
        shard, phrases, hashes = None, [], []
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), np.array(batch.column("kind").to_pylist())
            edge = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]))) if len(shards) else []
            for a, b in zip(edge, [*edge[1:], len(shards)], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, phrases, hashes = shards[a], [], []
                if kinds[a] == "p":
                    phrases += part.column("text").to_pylist()
                    hashes += part.column("h").to_pylist()
                    continue
                data, offsets = hashing.texts(part.column("text"))
                did, tk = part.column("did").to_numpy(), part.column("tk").to_numpy()
                for lo, hi in hashing.pieces(offsets, 2 * SHARD):
                    out = found_segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], phrases, np.array(hashes, np.int64).view(np.uint64), did[lo:hi], tk[lo:hi], segments)
                    found, none = passages.by_item(out), [None] * len(out)
                    none = none[: len(found)]
                    d, k, x, y = ([key[i] for key in found] for i in range(4))
                    yield _batch(["o"] * len(found), d, k, none, none, none, x, y, none, list(found.values()))
                    if len(segments) > HELD:  # a task's memory is bounded; equal segments collapse again later
                        yield from segment_rows(segments)
                        segments = {}
        yield from segment_rows(segments)

    def found_segments(data, offsets, phrases, hashes, did, tk, segments: dict) -> list[tuple]:  # noqa: ANN001
        """Runs the texts through the automata; fills segments and gives (did, tk, first window, segment)."""
        starts, ends, at = hashing.words(data, offsets)
        raw = data.tobytes()
        words = [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)]
        text, word, phrase = located([words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], phrases)
        place = at[text] + word
        out: list[tuple] = []
        single = len(at) == 2
        for base in range(0, max(1, len(words) - unit.window + 1), hashing.BLOCK if single else max(1, len(words))):
            size = min(hashing.BLOCK + unit.window - 1, len(words) - base) if single else len(words)
            rank = np.full(max(0, size - unit.gram + 1), hashing.NONE, np.uint64)
            here = (place >= base) & (place < base + len(rank))
            rank[place[here] - base] = hashing.ranked(hashes[phrase[here]], place[here] - base)
            named = np.zeros(len(rank), np.int64)
            named[place[here] - base] = phrase[here]
            for t, p, a, b in zip(*(x.tolist() for x in hashing.picks(rank, np.array([0, size]) if single else at, unit.window, unit.gram)), strict=True):
                segment = " ".join(words[base + a : base + b + unit.window])
                key = passages.item_hash(segment.encode())
                first = (int(did[t]), int(base + a - at[t]))
                out.append((first[0], int(tk[t]), first[1], *key))
                known = segments.get(key)
                if known is None:
                    segments[key] = [first, b - a + 1, int(hashing.signed(hashes[named[p : p + 1]])[0]), segment]
                elif first < known[0]:
                    known[0] = first
        return out

    def segment_rows(segments: dict) -> Iterator[pa.RecordBatch]:
        items = list(segments.items())
        for i in range(0, len(items), 4096):
            part = items[i : i + 4096]
            yield _batch(["s"] * len(part), [v[0][0] for _, v in part], [None] * len(part), [v[0][1] for _, v in part], [v[1] for _, v in part], [v[2] for _, v in part], [k[0] for k, _ in part], [k[1] for k, _ in part], [v[3] for _, v in part], [None] * len(part))

    return shards.select("shard", "kind", "h", "text", "did", "tk").mapInArrow(rows, schema)


def _batch(kind: list, did: list, tk: list, lo: list, n: list, h: list, ih1: list, ih2: list, segment: list, los: list) -> pa.RecordBatch:
    big = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), big(did), big(tk), big(lo), pa.array(n, pa.int32()), big(h), big(ih1), big(ih2), pa.array(segment, pa.string()), pa.array(los, pa.list_(pa.int64()))], ["kind", "did", "tk", "lo", "n", "h", "ih1", "ih2", "segment", "los"])


#: segments of one gram that are dealt to one task; a hotter gram is dealt to several
HOT = 512
#: segments that a task settles at once
SETTLED = 8192


def items(segments: DataFrame, unit: Words, hot: int = HOT) -> DataFrame:
    """passages.ITEM rows: whole segments alone in their gram, runs of windows of the others by the first occurrence
    that their task knows, and the windows of hot grams that no smaller document of their task holds."""
    grams = cut(segments.groupBy("h").agg((F.min("ih1") != F.max("ih1")).alias("several"), F.count("*").alias("rows")))
    least = segments.groupBy("ih1", "ih2").agg(F.min(F.struct("did", "lo")).alias("m"), F.max("n").alias("n"), F.max("h").alias("h"))
    least = cut(spread_join(least, grams, ["h"], ["ih1", "ih2"], "inner", grams.select("h", F.col("rows").alias("_n"))).select("h", "ih1", "ih2", "n", "several", "rows", F.col("m.did").alias("did"), F.col("m.lo").alias("lo")))
    none = F.lit(None).cast("long")
    alone = least.where("not several").select("ih1", "ih2", F.lit(0).alias("off"), "n", F.col("did").alias("fd"), F.col("lo").alias("fp"), none.alias("wh1"), none.alias("wh2"))
    # the text travels only for segments of several: (segment, did, lo) is one row
    ways = F.ceil(F.col("rows") / max(hot, 1)).cast("long")
    wanted = least.where("several").select("h", "ih1", "ih2", "did", "lo", (ways > 1).alias("more"), F.pmod("ih1", ways).alias("way"))
    mixed = segments.select("ih1", "ih2", "did", "lo", "segment").join(wanted, ["ih1", "ih2", "did", "lo"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # ordered by gram and way
            held.append(batch)
            if sum(b.num_rows for b in held) > SETTLED:
                part = pa.Table.from_batches(held)
                h, way = part.column("h").to_numpy(), part.column("way").to_numpy()
                begun = int(np.flatnonzero((h != h[-1]) | (way != way[-1]))[-1]) + 1 if h[0] != h[-1] or way[0] != way[-1] else 0
                if begun:  # the last gram may go on in the next batch
                    yield from settled(part.slice(0, begun))
                    held = part.slice(begun).to_batches()
        if held:
            yield from settled(pa.Table.from_batches(held))

    def settled(part: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        data, offsets = hashing.texts(part.column("segment"))
        one, starts, ends, at = hashing.word_hashes(data, offsets)
        h = one, hashing.span_hashes(data, starts, ends, 1)
        did, lo, more = (part.column(c).to_numpy() for c in ("did", "lo", "more"))
        return passages.settled_rows(np.column_stack([part.column(c).to_numpy() for c in ("ih1", "ih2")]), did, lo, h, at, unit.window, more)

    dealt = mixed.repartition(passages.parts_of(segments), "h", "way").sortWithinPartitions("h", "way")
    return alone.unionByName(dealt.mapInArrow(rows, passages.ITEM))


def verdicts(rows: DataFrame) -> DataFrame:
    """The ITEM rows without window hashes, and one for each open window that a document of another task holds earlier.

    An open window comes once a task, and more often only if one document repeats it, so its group stays small
    however many texts hold it; a window that is open in one task alone ends here, in no join.
    """
    places = F.collect_list(F.struct("ih1", "ih2", "off", "fd"))
    windows = rows.where("wh1 is not null").groupBy("wh1", "wh2").agg(F.min(F.struct("fd", "fp")).alias("m"), places.alias("places"))
    late = windows.select("m", F.explode(F.filter("places", lambda x: x["fd"] > F.col("m.fd"))).alias("x"))
    late = late.select("x.ih1", "x.ih2", "x.off", F.lit(1).alias("n"), "m.fd", "m.fp")
    return rows.where("wh1 is null").select(*late.columns).unionByName(late)


def removed_words(docs: DataFrame, firsts: DataFrame, window: int = 50, gram: int = 8) -> tuple[DataFrame, DataFrame]:
    """(texts that take part, removal ranges did, tk, ranges of window starts)."""
    unit = Words(window, gram)
    texts = passages.involved(docs, firsts, unit)
    phrases = cut(confirmed_phrases(texts, unit))
    found = stored(occurrences(sharded(texts, phrases, unit), unit), "passages-found", by="kind")
    rows = stored(items(found.where("kind = 's'"), unit), "passages-items")
    discard(found, "kind", "s")
    places = found.where("kind = 'o'").select("did", "tk", "los", "ih1", "ih2")
    ranges = cut(passages.removed(verdicts(rows), places, lambda fd, fp, did, lo: fd < did))
    for table in (rows, found):
        forget(table)
    return texts, ranges


def changed_texts(docs: DataFrame, firsts: DataFrame, window: int = 50, gram: int = 8, keep: bool = True) -> DataFrame:
    """did, tk, n_removed, kept_text, kept_sha256 of the different texts that lose words, the first row of each."""
    texts, ranges = removed_words(docs, firsts, window, gram)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept, digest = [], [], []
            for text, found in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words, out, at = text.as_py().encode().split(), [], 0
                for a, b in passages.covered([(r["a"], r["b"]) for r in found.as_py()], window):
                    out += words[at:a]
                    at = b
                out += words[at:]
                n.append(len(words) - len(out))
                line = b" ".join(out)
                kept.append(line.decode())
                digest.append(hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("tk"), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], ["did", "tk", "n_removed", "kept_text", "kept_sha256"])

    changed = ranges.join(texts.select("did", "tk", "text"), ["did", "tk"]).select("did", "tk", "text", "ranges")
    out = changed.mapInArrow(rows, "did bigint, tk bigint, n_removed bigint, kept_text string, kept_sha256 string")
    out = cut(out if keep else out.drop("kept_text"))
    forget(texts)
    return out


def digests(docs: DataFrame, firsts: DataFrame, changed: DataFrame, window: int = 50) -> DataFrame:
    """did, tk, n_words, n_removed, kept_sha256 of every row."""
    words = word_array(F.col("text"))
    rows = passages.by_text(docs, firsts, changed.select("did", "tk", "n_removed", "kept_sha256"), [F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("_sha")])
    copy = (F.col("did") > F.col("first")) & (F.col("n_words") >= window)  # an earlier row has the same text
    gone = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return rows.select("did", "tk", "n_words", gone.alias("n_removed"), F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"))


def cleaned(docs: DataFrame, window: int = 50, gram: int = 8, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text (words joined by one space; null where nothing was removed)."""
    firsts = passages.first_texts(docs)
    changed = changed_texts(docs, firsts, window, gram, keep=texts)
    out = digests(docs, firsts, changed, window)
    if texts:
        out = out.join(changed.select("did", "tk", "kept_text"), ["did", "tk"], "left")
        out = out.withColumn("kept_text", F.when((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words")), "").otherwise(F.col("kept_text")))
    return out.withColumn("doc_id", F.nullif(F.col("did"), F.lit(passages.LAST))).select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts)
