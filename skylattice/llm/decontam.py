"""Benchmark decontamination by template canonicalisation.

Texts are cut into runs of ASCII letters, digits and all characters beyond ASCII but currency signs; a letter after a
digit starts a new token. Numbers (in digits or words), names and units become typed placeholders, other tokens are
lower-cased (up to U+00DE); what a placeholder replaces is its slot's value. So a question asked again with other
numbers, people or units has the same template. Windows of ``window`` template tokens are hashed and joined with the
benchmark's windows.

A name is a token that starts with a capital and isn't written in capitals throughout. The first token of a sentence
may be a name or not, so windows with such tokens have several readings, each with a hash of its own. A unit is a known
unit right after a number, or after another unit and a slash.

Items that differ only in the values of their slots are one class: they have the same windows, so these are joined and
checked once for all of them. For each document and class the windows matched at one distance are one match. Its slots
are then checked: a name or unit of the item must stand for one value, and two for different ones; where readings
compete, the one of more places holds. Numbers are drawn anew and may be equal or differ by chance, so they are free. If
most named places (``MIN_HELD``) hold, windows with another place don't count unless they have an item's own values; else
only windows with its own values count. Those are found by a second hash, of the tokens with their values. A document is
contaminated if the windows that count, over all distances, cover enough of the item, or if some in a row make up a
passage of ``MIN_RUN`` tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.common import cut, without_ids

WINDOW = 8
#: A document has an item if consistent windows cover this share of the item's windows, and so many of them.
MIN_SHARE, MIN_WINDOWS = 0.25, 3
#: Also if so many consecutive tokens of an item are matched, however long it is.
MIN_RUN = 13
#: Of the places of names and units in a match, so many must fit one reading.
MIN_HELD = 2 / 3
#: A window with fewer tokens that aren't placeholders is looked for with the item's own values only.
MIN_LITERAL = 4
#: Bits of the sieve that the benchmark's hashes are put into; it goes to every task, whatever the benchmark's size.
SIEVE_BITS = 1 << 27

#: Units of measure and currency.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre "
    "kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons dollar dollars cent cents euro euros percent degree degrees mph kmh "
    "watt watts volt volts amp amps hz kb mb gb tb"
).split()

#: Number words. "one" isn't among them, it is mostly no number.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Currency signs beyond ASCII, which are no part of a token.
CURRENCY = "€£¥"

#: Random numbers that stand for the placeholders.
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x8F3A5C1E92B7D461, 0x1D4E8B2F6A90C357, 0xC5926E7F0B38A1D3))
_BASE, _MASK = 0xD6E8FEB86659FD93, (1 << 64) - 1
_KINDS = ("number", "name", "unit")
#: Sets hashes of windows with their values apart from those of templates.
_VALUES = np.uint64(0x6B79D8A3F04E215C)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = _UPPER | _DIGIT
_WORD[97:123] = True
_WORD[128:] = True
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n:", np.uint8))
_powers: list[np.ndarray] = []
#: Bytes that are cut into tokens at once.
_BLOCK = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    with np.errstate(over="ignore"):
        up, down = (np.full(max(n, 2 * _BLOCK), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        made = [np.cumprod(up), np.cumprod(down)]
    if n <= 2 * _BLOCK:
        _powers[:] = made
    return made[0], made[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Tokens:
    """Tokens of a block of UTF-8 texts, each followed by a line end: starts, ends, kinds (-1: literal) and hashes.

    ``either`` marks tokens that may also be a name; ``named`` has the hashes of that reading.
    """

    def __init__(self, block: bytes):
        raw = np.frombuffer(block, np.uint8)
        self.block, n = block, len(raw)
        folded, word, digit = _FOLD[raw], _WORD[raw], _DIGIT[raw]
        before = np.zeros(n, bool)
        capital = _UPPER[raw]
        if n > 1:
            latin = np.zeros(n, bool)  # the capitals from U+00C0 to U+00DE
            latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
            folded = np.where(latin, folded + 32, folded)
            capital[:-1] |= latin[1:]
            inner = np.zeros(n, bool)  # points and commas inside numbers
            inner[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
            word = word | inner
            for sign in _SIGNS:
                found = np.ones(max(0, n - len(sign) + 1), bool)
                for k, x in enumerate(sign):
                    found &= raw[k : n - len(sign) + 1 + k] == x
                for k in range(len(sign)):
                    word[np.flatnonzero(found) + k] = False
            before[1:] = word[:-1] & ~(digit[:-1] & _LETTER[raw[1:]])
        self.starts = s = np.flatnonzero(word & ~before)
        after = np.zeros(n + 1, bool)
        after[1:] = word
        after[:-1] &= ~(word & before)
        self.ends = e = np.flatnonzero(after)
        up, down = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            self.hashes = _mixed((sums[e] - sums[s]) * down[s])
        stops, lower = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        np.cumsum(_STOP[raw] & ~word, out=stops[1:])
        np.cumsum((raw >= 97) & (raw <= 122), out=lower[1:])
        fresh = np.ones(len(s), bool)
        fresh[1:] = stops[s[1:]] > stops[e[:-1]]
        self.kinds = kinds = np.full(len(s), -1, np.int8)
        number = digit[s] | np.isin(self.hashes, _NUMBER_HASHES)
        name = capital[s] & (lower[e] > lower[s]) & ~number
        kinds[name & ~fresh] = 1
        self.either = name & fresh
        kinds[number] = 0
        for i in np.flatnonzero(number[:-1] & ~number[1:] & ~fresh[1:]) + 1:
            while i < len(s) and block[s[i] : e[i]].lower() in _UNIT_SET:
                kinds[i] = 2
                i += 1
                if i == len(s) or block[e[i - 1] : s[i]] != b"/":
                    break
        self.values = self.hashes.copy()
        for k, h in enumerate((_NUMBER, _NAME, _UNIT)):
            self.hashes[kinds == k] = h
        self.named = np.where(self.either, _NAME, self.hashes)

    def value(self, i: int) -> str:
        return self.block[self.starts[i] : self.ends[i]].decode("utf-8", "replace").lower()

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Starts of windows, their hashes, and the reading: of all first tokens of sentences as literals (0) or names
        (1), of only the first in the window as a name (2) or as a literal (3), or of all tokens with their values (-1).
        """
        n = len(self.hashes) - size + 1
        if n <= 0:
            return
        factors = np.array([pow(_BASE, 2 * k + 1, 1 << 64) for k in range(size)], np.uint64)
        sizes = np.uint64((size * 0x9E3779B97F4A7C15) & _MASK)
        with np.errstate(over="ignore"):
            plain, named, valued = (
                sum((h[k : n + k] * factors[k] for k in range(size)), np.zeros(n, np.uint64)) for h in (self.hashes, self.named, self.values)
            )
            every = np.arange(n)
            yield every, _mixed(valued) ^ _VALUES ^ sizes, -1
            yield every, _mixed(plain) ^ sizes, 0
            count = np.concatenate([[0], np.cumsum(self.either)])
            count = count[size:] - count[:-size]
            one = np.flatnonzero(count > 0)
            yield one, _mixed(named[one]) ^ sizes, 1
            two = np.flatnonzero(count > 1)
            if len(two):
                places = np.flatnonzero(self.either)
                first = places[np.searchsorted(places, two)]
                change = (self.named[first] - self.hashes[first]) * factors[first - two]
                yield two, _mixed(plain[two] + change) ^ sizes, 2
                yield two, _mixed(named[two] - change) ^ sizes, 3

    def slots(self, at: int, size: int, reading: int) -> tuple[list[str], list[int]]:
        """Values of the slots of a window under a reading, with their kinds, and their places in the window."""
        slots, places, seen = [], [], 0
        for k in range(at, at + size):
            kind = self.kinds[k]
            if self.either[k]:
                seen += 1
                if reading == 1 or reading == 2 and seen == 1 or reading == 3 and seen > 1:
                    kind = 1
            if kind >= 0:
                slots.append(f"{_KINDS[kind]}={self.value(k)}")
                places.append(k - at)
        return slots, places


def template(text: str | None) -> tuple[list[str], list[str | None]]:
    """Template tokens of a text, first tokens of sentences as literals, and for each the slot's value or None."""
    t = _Tokens((text or "").encode("utf-8", "replace") + b"\n")
    kinds = t.kinds.tolist()
    return (
        [f"<{_KINDS[k]}>" if k >= 0 else t.value(i) for i, k in enumerate(kinds)],
        [t.value(i) if k >= 0 else None for i, k in enumerate(kinds)],
    )


_UNIT_SET = frozenset(x.encode() for x in UNITS)
_SIGNS = [x.encode() for x in CURRENCY]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_NUMBER_HASHES = np.zeros(0, np.uint64)
_NUMBER_HASHES = np.sort(_Tokens("\n".join(NUMBER_WORDS).encode() + b"\n").values)


def _blocks(texts: list, most: int) -> Iterator[tuple[_Tokens, list[int], np.ndarray, int, bool]]:
    """Tokens of the texts by blocks: tokens, the texts' numbers, where they end, the number of the first token, and
    whether the block goes on with a text, from ``most`` tokens before the last block's end.
    """
    at = 0
    while at < len(texts):
        parts, owners, length = [], [], 0
        while at < len(texts) and (not parts or length < _BLOCK):
            raw = (texts[at] or "").encode("utf-8", "replace")
            if len(raw) > _BLOCK:
                if parts:
                    break
                yield from _pieces(raw, at, most)
                at += 1
                continue
            parts.append(raw)
            owners.append(at)
            length += len(raw) + 1
            at += 1
        if parts:
            yield _Tokens(b"\n".join(parts) + b"\n"), owners, np.cumsum([len(p) + 1 for p in parts]), 0, False


def _pieces(raw: bytes, owner: int, most: int) -> Iterator[tuple[_Tokens, list[int], np.ndarray, int, bool]]:
    at = base = 0
    length, goes_on = _BLOCK, False
    while True:
        space = _SPACE.search(raw, at + length) if at + length < len(raw) else None
        end = space.start() if space else len(raw)
        t = _Tokens(raw[at:end] + b"\n")
        again = len(t.starts) - most
        if end < len(raw) and again <= 0:
            length *= 2  # tokens are so long that the piece holds too few
            continue
        yield t, [owner], np.array([end - at + 1]), base, goes_on
        if end == len(raw):
            return
        at, base, length, goes_on = at + int(t.starts[again]), base + again, _BLOCK, True


_SPACE = re.compile(rb"[\x20\t\n]")


def _rows(idents: list, texts: list, sizes: list[int], sieve: np.ndarray | None) -> Iterator[tuple]:
    most = max(sizes)
    for t, owners, borders, base, goes_on in _blocks(texts, most):
        first_token = np.searchsorted(t.starts, np.concatenate([[0], borders]))
        for size in sizes:
            for starts, hashes, reading in t.windows(size):
                if sieve is not None:
                    place = hashes & np.uint64(8 * len(sieve) - 1)
                    found = sieve[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                    keep = np.flatnonzero(found)
                    starts, hashes = starts[keep], hashes[keep]
                owner = np.searchsorted(borders, t.starts[starts], side="right")
                keep = owner == np.searchsorted(borders, t.starts[starts + size - 1], side="right")
                if goes_on:
                    keep &= starts > most - size
                if sieve is None:  # an item is cut into windows, or is one if it is shorter
                    n = np.diff(first_token)[owner]
                    keep &= n == size if size < most else n >= size
                for i, h, o in zip(starts[keep].tolist(), hashes[keep].astype(np.int64).tolist(), owner[keep].tolist()):
                    if reading < 0:
                        yield idents[owners[o]], size, base + i - int(first_token[o]), h, None, None
                    else:
                        slots, places = t.slots(i, size, reading)
                        if size - len(places) >= MIN_LITERAL:
                            yield idents[owners[o]], size, base + i - int(first_token[o]), h, slots, places


def _schema(ident: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(ident, T.LongType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("at", T.IntegerType()),
            T.StructField("hash", T.LongType()),
            T.StructField("slots", T.ArrayType(T.StringType())),
            T.StructField("places", T.ArrayType(T.IntegerType())),
        ]
    )


def windows(rows: DataFrame, id_col: str, text_col: str, ident: str, sizes: list[int], sieve: np.ndarray | None = None) -> DataFrame:
    """Windows of every text: id, size, position, hash, slot values in order, their places.

    Each has a row without slots for the hash of its tokens with all values, and one for each reading of its template
    with ``MIN_LITERAL`` literal tokens. ``sieve`` (bits): only those that it lets through. Without it the rows are
    items: those as long as the largest size have windows of it, others of a smaller size are one window of all tokens.
    """
    schema = _schema(ident)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _rows(batch["ident"].tolist(), batch["text"].tolist(), sizes, sieve)
            while part := list(islice(rows, 1 << 16)):
                yield pd.DataFrame(part, columns=schema.names)

    return rows.select(F.col(id_col).cast("bigint").alias("ident"), F.col(text_col).alias("text")).where(
        "ident is not null and text is not null"
    ).mapInPandas(cut_up, schema)


def _sieve(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, packed: 32 bits a hash up to ``SIEVE_BITS``, so the driver gets 16 MB at most."""
    n = hashes.count()
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(20, (32 * n).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    groups = hashes.groupBy(F.shiftright(place, 13).alias("page")).agg(F.collect_set(place.bitwiseAND(F.lit(8191)).cast("smallint")).alias("bits"))
    sieve = np.zeros(bits, np.uint8)
    for page, on in groups.toLocalIterator():
        sieve[(page << 13) + np.array(on, np.int64)] = 1
    return np.packbits(sieve, bitorder="little")


@F.pandas_udf(T.StringType())
def _class_key(texts: pd.Series) -> pd.Series:
    """The template with which of its names and units are equal: the same for items that differ in values only."""
    keys = []
    for text in texts:
        t = _Tokens((text or "").encode("utf-8", "replace") + b"\n")
        order: dict[str, int] = {}
        kinds = np.where(t.either, 1, t.kinds).tolist()
        numbered = lambda i, k: "" if k == 0 else str(order.setdefault(f"{k}={t.value(i)}", len(order)))  # noqa: B023, E731
        # The first tokens of sentences have two readings, so these must be the same.
        whole = " ".join(
            t.value(i) if k < 0 else f"<{_KINDS[k]}{numbered(i, k)}{'=' + t.value(i) if t.either[i] else ''}>" for i, k in enumerate(kinds)
        )
        keys.append(hashlib.sha256(whole.encode("utf-8", "replace")).hexdigest())
    return pd.Series(keys, dtype=object)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE,
    min_windows: int = MIN_WINDOWS, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Contaminated pairs: ``doc_id``, ``item_id``, ``n_windows`` (the item's), ``n_matched``, ``share``, ``exact``.

    ``exact`` is true if all slot values are the item's own; otherwise the question was asked with other values.
    Items shorter than a window are matched by one window of all their tokens if they have at least 4; shorter ones
    can't be told from chance and are never reported. Windows with under ``MIN_LITERAL`` literal tokens, of short items too,
    count only with the item's own values. Null ids and null texts match nothing. Repeated ids count as one
    document. Ids are integers, or cast to them. Empty tables give no rows; other columns are not looked at.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    keyed = cut(items.select("item_id", _class_key("text").alias("key")).distinct())
    classes = cut(keyed.join(keyed.groupBy("key").agg(F.min("item_id").alias("class")), "key").select("item_id", "class").distinct())
    own = windows(items, "item_id", "text", "item_id", [*range(4, window), window])
    # Of a class, only its first item's templates are needed; values are needed of all.
    own = cut(own.join(classes, "item_id").where("slots is null or item_id = class").distinct())
    sizes = sorted(r[0] for r in own.select("size").distinct().collect()) or [window]
    theirs = windows(docs, id_col, text_col, "doc_id", sizes, _sieve(own.select("hash").distinct())).drop("places", "size")
    met = cut(
        theirs.withColumnsRenamed({"at": "doc_at", "slots": "doc_slots"})
        .join(own.withColumnsRenamed({"at": "item_at", "slots": "item_slots", "places": "item_places"}), "hash")
        .withColumn("shift", F.col("doc_at") - F.col("item_at"))
    )
    # A copy of the item lies at one distance from the item's start: windows with the same distance are one match.
    window_of = F.struct(
        "item_at", F.col("item_slots").alias("a"), F.col("doc_slots").alias("b"), F.transform("item_places", lambda x: x + F.col("item_at")).alias("at")
    )
    place = ["doc_id", "class", "shift"]
    templates = met.where("item_slots is not null").groupBy(place).agg(_consistent(F.collect_set(window_of)).alias("fit")).where(F.size("fit") > 0)
    valued = met.where("item_slots is null").groupBy(*place, "item_id").agg(F.collect_set("item_at").alias("own"))
    # Where an item's own values are found, it is judged by those and what its class has there.
    pairs = valued.select("doc_id", "class", "item_id").distinct()
    others = templates.join(pairs, ["doc_id", "class"]).select(*place, "item_id", "fit", F.array().cast("array<int>").alias("own"))
    both = others.unionByName(valued.withColumn("fit", F.array().cast("array<int>"))).groupBy(*place, "item_id").agg(
        F.array_distinct(F.flatten(F.collect_list("fit"))).alias("fit"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")
    )
    none = F.array().cast("array<int>")
    alone = templates.select(*place, F.lit(None).cast("bigint").alias("item_id"), "fit", none.alias("own"))
    all_of = F.sort_array(F.array_union("fit", "own"))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    counts = own.groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"), F.max("size").alias("size"))
    scored = (
        both.unionByName(alone)
        .withColumn("all", all_of)
        .groupBy("doc_id", "class", "item_id")
        .agg(union("all").alias("n_matched"), union("own").alias("n_own"), F.max(_longest("all")).alias("run"))
        .join(counts.withColumnRenamed("item_id", "of"), F.coalesce("item_id", "class") == F.col("of"))
        .withColumn("share", F.col("n_matched") / F.col("n_windows"))
        .where(
            ((F.col("share") >= min_share) & (F.col("n_matched") >= F.least(F.when(F.col("size") == window, min_windows).otherwise(1), F.col("n_windows"))))
            | (F.col("run") >= F.lit(min_run) - F.col("size") + 1)
        )
    )
    # What a class is found by, all its items are.
    expanded = scored.where("item_id is null").drop("item_id").join(classes, "class").unionByName(scored.where("item_id is not null"))
    best = F.max(F.struct("n_matched", "n_own", "n_windows", "share"))
    return expanded.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.n_windows").cast("bigint").alias("n_windows"), F.col("b.n_matched").cast("bigint").alias("n_matched"),
        "b.share", (F.col("b.n_matched") == F.col("b.n_own")).alias("exact"),
    )


def _longest(c: str) -> Column:
    """The length of the longest run of consecutive numbers in a sorted array."""
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(c, start, step, lambda s: s["most"])


def consistent(found: list[tuple]) -> list[int]:
    """Places of the windows of a match whose names and units fit.

    ``found``: place, the item's slots, the document's, and the slots' places.
    """
    named = {(at, a, b) for _, ours, theirs, places in found for a, b, at in zip(ours, theirs, places) if not a.startswith("number=")}
    votes = Counter((a, b) for _, a, b in named)
    held, taken = {}, set()
    for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
        if a not in held and b not in taken:
            held[a] = b
            taken.add(b)
    if sum(held.get(a) == b for _, a, b in named) < MIN_HELD * len(named):
        return []
    right = lambda ours, theirs: all(a.startswith("number=") or held.get(a) == b for a, b in zip(ours, theirs))
    return sorted({x[0] for x in found if right(x[1], x[2])})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _consistent(matches: pd.Series) -> pd.Series:
    keys = ("item_at", "a", "b", "at")
    return pd.Series([consistent([tuple(w[k] for k in keys) for w in m]) for m in matches], dtype=object)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Contaminated documents: ``doc_id``, ``contaminated`` (true), ``item_ids`` (sorted), ``max_share``, ``reworded``.

    ``reworded`` is true if no item is matched with its own values. Clean documents have no row. See ``matches`` for
    nulls, ties and short texts.
    """
    return matches(docs, benchmark, **options).groupBy("doc_id").agg(
        F.lit(True).alias("contaminated"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max("share").alias("max_share"),
        (~F.max("exact")).alias("reworded"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without contamination, all their columns kept; rows with a null id stay."""
    bad = matches(docs, benchmark, **options).select("doc_id").distinct()
    return without_ids(docs, bad, options.get("id_col", "doc_id"))
