"""SimHash near-duplicates, found by pigeonring chains of segments.

A text is lower-cased (A-Z only) and cut into words; every run of ``shingle`` words is a shingle. A bit of the
fingerprint is 1 if it is set in over half of the shingles' hashes. Fingerprints that differ in few enough bits are
linked, and documents reachable over links form a component.

The bits form a ring of equal segments. If two fingerprints differ in at most t of m segments' bits, then some start on
the ring has, for every length l, at most floor(l * t / m) differing bits in the l segments from there (the pigeonring
principle). The first segments must be equal, so they serve as the key of a hash join; the budgets of the longer chains
prune the pairs before the full Hamming check. Two settings of this:

* Close copies (``near_duplicates``): 64 bits of XXH64 (seed 42) over three words, repeats included, at most 2 differing.
  The chains whose budget is 0 are three of eight segments long, and so exact: no link is lost. Where more than
  ``bucket_limit`` fingerprints meet under a key, the key is lengthened: the other bits are cut into one part more than
  may differ, one of which must be equal too. This goes on while keys are crowded and have free bits to add.
* Likeness of 0.8 (``deduplicated``): sets of five words, of which pairs differ in about 15 % of the bits. No chain of a
  useful length has the budget 0 there, so this takes long fingerprints, with so many segments that a pair shares some
  of them (``ring_of``). Recall isn't exact but computed and measured. What meets under a key isn't paired out: all are
  checked against one of them, the lead, and components made; then what is still apart is checked, and only that.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.common import connected_components, cut, shuffled, without_ids

SEED = 42
#: The likeness that long fingerprints are made for, the share of bits that may differ, and the share that differs at 0.8.
SHINGLE, DIFFER, AT_ALIKE = 5, 0.165, 0.1515
#: Bits and number of segments for up to 2^17 texts; for more the bits grow with their logarithm.
WIDTH, SEGMENTS = 20, 80
_CHUNK = 1 << 16
_BLOCK = 1 << 13
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: str | None, shingle: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(first, last)]


def simhash(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed number; 0 for null and texts without words."""
    hashes = _hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = np.array(hashes[at : at + _CHUNK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (bigint) of every row; null texts have fingerprint 0."""
    return docs.select(F.col(id_col).alias("doc_id"), simhash_column(F.col(text_col)).alias("fp"))


def _counted(hashes: np.ndarray, owners: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each of ``n`` owners and each bit: how many of its hashes, drawn out to ``words`` words, have the bit."""
    counts = np.zeros((n, words, 8, 8), np.uint32)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), _BLOCK):
        h = hashes[at : at + _BLOCK, None] + steps
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        own = owners[at : at + _BLOCK]
        place = np.arange(len(own))
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        since = place - np.maximum.accumulate(np.where(fresh, place, 0))
        # Bytes count up to 255 hashes of one owner at a time.
        starts = np.flatnonzero(since % 255 == 0)
        whose = own[starts]
        firsts = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, starts, axis=0)
            lanes = lanes.view(np.uint8).reshape(len(starts), words, 8)
            counts[whose[firsts], :, :, bit] += np.add.reduceat(lanes, firsts, axis=0, dtype=np.uint32)
    return counts


def long_fingerprints(texts: list[str | None], words: int, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of ``words`` 64-bit words, of the sets of shingles; 0 for null and texts without words."""
    out = np.zeros((len(texts), words), np.int64)
    at = 0
    while at < len(texts):
        sets, held, first = [], 0, at
        while at < len(texts) and len(sets) < 256 and (not sets or held < _BLOCK):
            sets.append(np.unique(np.array(_hashes(texts[at], shingle), np.uint64)))
            held += len(sets[-1])
            at += 1
        sizes = np.array([len(s) for s in sets])
        if held:
            counts = _counted(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), words)
            most = counts.reshape(len(sets), -1) * 2 > sizes[:, None]
            out[first:at] = np.packbits(most, axis=1).view(">i8").astype(np.int64)
    return out


def long_column(text: Column, words: int, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(list(long_fingerprints(texts.tolist(), words, shingle)), dtype=object)

    return prints(text)


def _rotated(c: Column, by: int) -> Column:
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def lengthened(mask: int, parts: int) -> list[int]:
    """The masks that add one of ``parts`` parts of the free bits to ``mask``."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:b_]) for a, b_ in zip(cuts, cuts[1:])]


def links(fps: DataFrame, max_bits: int = 2, segments: int = 8, bucket_limit: int = 64) -> DataFrame:
    """All pairs (``u``, ``v``) of fingerprints with at most ``max_bits`` differing bits; a pair may come repeatedly.

    ``fps`` has distinct fingerprints in ``fp``. ``bucket_limit`` decides how long keys get, not what is found.
    """
    if 64 % segments or not 0 <= max_bits < segments:
        raise ValueError("segments must divide 64 and exceed max_bits")
    width = 64 // segments
    budget = {n: n * max_bits // segments for n in range(1, segments + 1)}
    equal = max(n for n in budget if budget[n] == 0)
    if equal == segments:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    masks = [((1 << width * equal) - 1) << (64 - width * equal)]
    chains = [
        (64 - width * n, budget[n])
        for n in range(equal + 1, segments)
        if budget[n] != budget[n + 1]  # the longest chain of each budget implies the shorter ones
    ]
    rows = fps.select(
        "fp", F.posexplode(F.array(*[_rotated(F.col("fp"), width * i) for i in range(segments)])).alias("start", "ring")
    ).withColumn("mask", F.lit(_signed(masks[0])))
    found = None
    while True:
        key = ["start", "mask", "key"]
        rows = rows.withColumn("key", F.col("ring").bitwiseAND(F.col("mask")))
        met = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        free = 64 - masks[0].bit_count()
        longest = free < 6 * (max_bits + 1)  # then few fingerprints are left that a key can hold
        members = rows.join(met if longest else met.where(F.col("n") <= bucket_limit), key)
        a = members.select(*key, F.col("fp").alias("u"), F.col("ring").alias("ring_u"))
        b = members.select(*key, F.col("fp").alias("v"), F.col("ring").alias("ring_v"))
        differing = F.col("ring_u").bitwiseXOR(F.col("ring_v"))
        pairs = a.join(b, key).where(F.col("u") < F.col("v"))
        for shift, most in [*chains, (0, max_bits)]:
            pairs = pairs.where(F.bit_count(F.shiftrightunsigned(differing, shift)) <= most)
        found = pairs.select("u", "v") if found is None else found.unionByName(pairs.select("u", "v"))
        if longest:
            return found
        crowded = cut(rows.join(met.where(F.col("n") > bucket_limit), key).select("fp", "start", "ring", "mask"))
        if crowded.isEmpty():
            return found
        longer = {m: lengthened(m, max_bits + 1) for m in masks}
        masks = [x for m in masks for x in longer[m]]
        table = F.create_map(*[x for m, more in longer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in more]))])
        rows = crowded.select("fp", "start", "ring", F.explode(table[F.col("mask")]).alias("mask"))


def _classes(prints: DataFrame, max_bits: int, segments: int, bucket_limit: int) -> DataFrame:
    """``fp``, ``label`` and ``component_id`` of every fingerprint."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(classes.select("fp"), max_bits, segments, bucket_limit))
    member = classes.join(found, classes["fp"] == found["vertex"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    least = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return member.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, segments: int = 8, bucket_limit: int = 64
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, its component's smallest id.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an id are all returned.
    A null id counts as no id: such rows get the smallest id of the component, or null if it has none. An empty table
    gives no rows; other columns are not looked at.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    members = _classes(prints, max_bits, segments, bucket_limit).select("fp", "component_id")
    return prints.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def ring_of(n_texts: int) -> tuple[int, int, int]:
    """Bits of a segment, number of segments and 64-bit words of the fingerprints for so many texts.

    Other texts meet under a key by chance the less the longer it is, so its bits grow with the logarithm of the texts;
    a pair that is 0.8 alike has a segment in common the less often, so their number grows in proportion. The computed
    chance to find such a pair stays the same, about 0.95.
    """
    width = min(32, max(WIDTH, math.ceil(math.log2(max(1, n_texts))) + 3))
    segments = math.ceil(SEGMENTS * (1 - AT_ALIKE) ** (WIDTH - width))
    return width, segments, -(-width * segments // 64)


def _kept_in(u: str, v: str, width: int) -> Column:
    """Whether the chains of whole segments that 64 bits hold keep to their budgets."""
    differing = F.col(u).bitwiseXOR(F.col(v))
    fits = F.lit(True)
    for n in range(2, 64 // width + 1):
        fits = fits & (F.bit_count(F.shiftrightunsigned(differing, 64 - n * width)) <= int(n * width * DIFFER))
    return fits


def _alike(words: int) -> Column:
    """Whether ``fp_u`` and ``fp_v`` differ in few enough bits."""
    differing = F.aggregate(F.zip_with("fp_u", "fp_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return differing <= int(words * 64 * DIFFER)


def _with_print(rows: DataFrame, classes: DataFrame, more: list[Column]) -> DataFrame:
    """``ck``, ``fp`` and ``more`` of each distinct row; the rows of a class are gathered, so it is joined once.

    A class has a row for each segment at most, which bounds what is gathered.
    """
    held = rows.groupBy("ck").agg(F.collect_set(F.struct(*more)).alias("held"))
    return held.join(shuffled(classes.select("ck", "fp")), "ck").select("ck", "fp", F.explode("held").alias("x")).select("ck", "fp", "x.*")


def _labelled(rows: DataFrame, labels: DataFrame, vertex: str, name: str) -> DataFrame:
    known = labels.select(F.col("vertex").alias(vertex), F.col("label").alias(name))
    return rows.join(shuffled(known), vertex, "left").withColumn(name, F.coalesce(name, vertex))


def _with_partner(rows: DataFrame, others: DataFrame, width: int) -> DataFrame:
    """The rows that share a key with one of ``others`` that has another label and keeps to the chains with them."""
    others = others.select(*(F.col(c).alias(f"{c}_o") for c in ("start", "key", "ring", "label")))
    same = (F.col("start") == F.col("start_o")) & (F.col("key") == F.col("key_o"))
    return rows.join(shuffled(others), same & (F.col("label") != F.col("label_o")) & _kept_in("ring", "ring_o", width), "left_semi")


def long_components(classes: DataFrame, width: int, segments: int, words: int) -> DataFrame:
    """``ck``, ``first_id`` and ``label`` of classes ``ck``, ``first_id``, ``fp`` (distinct long fingerprints).

    Two classes are linked if they share a segment, the chains from there keep to their budgets and at most ``DIFFER``
    of all bits differ.
    """
    at = F.col("start") * width
    word = lambda i: F.element_at("fp", (F.pmod(i, F.lit(words)) + 1).cast("int"))
    q, r = F.floor(at / 64), F.pmod(at, F.lit(64)).cast("int")
    ring = (
        classes.select("ck", "fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("start"))
        .select("ck", "start", word(q).alias("here"), word(q + 1).alias("next"), r.alias("r"))
        .select("ck", "start", F.expr("shiftleft(here, r) | shiftrightunsigned(shiftrightunsigned(next, 1), 63 - r)").alias("ring"))
        .withColumn("key", F.shiftrightunsigned("ring", 64 - width))
    )
    # The same order as in the first round of the components, so that stars around leads go in one round.
    order = F.struct(F.xxhash64("ck", F.lit(0)).alias("rank"), "ck", "ring")
    leads = ring.groupBy("start", "key").agg(F.min(order).alias("head"), F.count("*").alias("n")).where("n > 1")
    leads = leads.select("start", "key", "n", F.col("head.ck").alias("lead"), F.col("head.ring").alias("lead_ring"))
    near = (F.col("ck") != F.col("lead")) & _kept_in("ring", "lead_ring", width)
    met = cut(ring.join(shuffled(leads), ["start", "key"]).where((F.col("n") > 2) | near))
    stars = _with_print(met.where(near), classes, [F.col("lead").alias("u")])
    stars = stars.withColumnsRenamed({"ck": "v", "fp": "fp_v"}).join(shuffled(classes.select(F.col("ck").alias("u"), F.col("fp").alias("fp_u"))), "u")
    stars = stars.where(_alike(words)).select("u", "v")
    labels = cut(connected_components(stars))
    # Two of a key have met each other. Of the others those are left that aren't connected with the lead.
    crowd = met.where("n > 2").select("start", "key", "ck", "ring", "lead")
    rows = cut(_labelled(_labelled(crowd, labels, "ck", "label"), labels, "lead", "lead_label"))
    rest = rows.where("label <> lead_label")
    # Only rows that keep to the chains with one of another label get their fingerprint.
    open_, rest = _with_partner(rows, rest, width), _with_partner(rest, rows, width)
    # Here a pair may be far apart and yet keep to the chains, so the whole fingerprints are compared inside the join.
    side = lambda x: [F.col(c) for c in ("start", "key", "lead_label")] + [F.col("ring").alias(f"ring_{x}"), F.col("label").alias(f"in_{x}")]
    a = _with_print(open_, classes, side("u")).withColumnsRenamed({"ck": "u", "fp": "fp_u"})
    b = _with_print(rest, classes, side("v")).withColumnsRenamed({"ck": "v", "fp": "fp_v"}).drop("lead_label")
    apart = a.join(shuffled(b), ["start", "key"]).where(
        (F.col("in_u") != F.col("in_v"))
        & ((F.col("in_u") == F.col("lead_label")) | (F.col("u") < F.col("v")))
        & _kept_in("ring_u", "ring_v", width)
        & _alike(words)
    )
    above = connected_components(apart.select(F.col("in_u").alias("u"), F.col("in_v").alias("v")))
    # Components of the labels: that of a class's label, or the label itself where it is linked to no other.
    low = _labelled(classes.select("ck", "first_id"), labels, "ck", "label")
    return _labelled(low, above, "label", "top").select("ck", "first_id", F.col("top").alias("label"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of texts about 0.8 alike (Jaccard, sets of five words), all its columns kept.

    The one with the smallest id stays. Texts without words are alike. Of rows that repeat the smallest id, any one
    stays. Rows with a null id go if their component has an id, else any one of the component stays.
    """
    width, segments, words = ring_of(docs.count())
    mark = F.xxhash64(long_column(F.col(text_col), words))
    prints = cut(
        docs.select(F.col(id_col).alias("doc_id"), long_column(F.col(text_col), words).alias("fp")).withColumn("ck", F.xxhash64("fp"))
    )
    classes = cut(prints.groupBy("ck").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp")))
    member = cut(long_components(classes, width, segments, words))
    least = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    members = cut(member.join(shuffled(least), "label").select("ck", "label", "component_id"))
    kept = members.where("component_id is not null").select("component_id").distinct()
    found = prints.where("doc_id is not null").select("doc_id", "ck").join(shuffled(members.select("ck", "component_id")), "ck")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    gone = gone.join(shuffled(kept), gone["doc_id"] == kept["component_id"], "left_anti")
    out = without_ids(docs.where(F.col(id_col).isNotNull()), gone, id_col)
    ids = prints.where("doc_id is not null").groupBy("doc_id").count()
    if not ids.where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col])
    if prints.where("doc_id is null").isEmpty():
        return out
    nameless = docs.where(F.col(id_col).isNull()).withColumn("__ck", mark)
    alone = members.where("component_id is null").select(F.col("ck").alias("__ck"), F.col("label").alias("__label"))
    return out.unionByName(nameless.join(shuffled(alone), "__ck").dropDuplicates(["__label"]).drop("__ck", "__label"))
