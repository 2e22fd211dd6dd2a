import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import simhash
from skylattice.llm.common import connected_components
from tests.llm.cases import DOCS, docs


def _plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="AbC é\t\n\x0b x", max_size=60))
def test_fingerprint(text):
    assert simhash.simhash(text) % 2**64 == _plain(text)


def _components(prints):
    """Brute force: rows of (id, fingerprint) to the smallest id that can be reached."""
    label = list(range(len(prints)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(prints):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return [least.get(find(i)) for i in range(len(prints))]


def test_rows(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(300)]
    rows = list(DOCS)
    for i in range(60):
        copy = list(base)
        if i % 3:
            copy[r.randrange(300)] = "edit"
        rows.append((100 + i, " ".join(copy), "en", "a", 1))
    rows += [(200 + i, " ".join(r.choice(words) for _ in range(5)), "en", "a", 1) for i in range(40)]
    got = simhash.near_duplicates(docs(spark, rows).coalesce(2)).collect()
    assert len(got) == len(rows)
    expected = sorted(map(repr, zip([x[0] for x in rows], [f"{_plain(x[1]):016x}" for x in rows], _components([(x[0], _plain(x[1])) for x in rows]))))
    assert sorted(repr(tuple(x)) for x in got) == expected
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [2, 64])
@pytest.mark.parametrize("segments", [4, 8, 16])
def test_links_join_the_same_as_all_pairs(spark, limit, segments):
    r = random.Random(segments)
    prints = {0, -1}
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(12):
            prints.add(simhash._signed(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5)))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {x["vertex"]: x["label"] for x in connected_components(simhash.links(frame, 2, segments, limit)).collect()}
    labels = [found.get(p, p) for p in prints]
    expected = _components([(i, p % 2**64) for i, p in enumerate(prints)])
    assert len(set(zip(labels, expected))) == len(set(labels)) == len(set(expected))


def test_lengthened_keys():
    masks = simhash.lengthened(((1 << 24) - 1) << 40, 3)
    assert sum(m & ((1 << 40) - 1) for m in masks) == (1 << 40) - 1 and all(m >> 40 == (1 << 24) - 1 for m in masks)


def test_other_distances(spark):
    prints = [0, 0b111, 0b1111, 1 << 40]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(min(x), max(x)) for x in simhash.links(frame, 3, 8).collect()}
    assert got == {(0, 7), (7, 15), (0, 1 << 40)}
    with pytest.raises(ValueError):
        simhash.links(frame, 8, 8)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (-5, 100)]
    got = {x["vertex"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (100, 101, -5)}) == 1 and len(set(got.values())) == 2
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    edges = spark.range(50).selectExpr("id AS u", "id + 1 AS v").mapInPandas(counted, "u long, v long")
    assert len({x["label"] for x in connected_components(edges).collect()}) == 1
    assert read.value == 50


def test_deduplicated(spark):
    out = simhash.deduplicated(docs(spark)).collect()
    texts = [x["text"] for x in out]
    assert len(out) == len({(t or "").strip() for _, t, *_ in DOCS}) and len(out[0]) > 5
    assert texts.count("The cat sat on the mat and looked at the moon.") == 1
    assert any(x["doc_id"] is None and x["text"] for x in out)
    nameless = [(None, "one two three four five", None, None, None)] * 3
    assert simhash.deduplicated(docs(spark, nameless)).count() == 1


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b):
    x, y = _set(a), _set(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def _edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"e{r.randrange(10**9)}"
    return " ".join(words)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="Ab c", max_size=400), max_size=5))
def test_long_fingerprints(texts):
    got = simhash.long_fingerprints(texts, 3)
    for text, print_ in zip(texts, got):
        hashes = np.unique(np.array(simhash._hashes(text, 5), np.uint64))
        drawn = hashes[:, None] + np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        drawn = (drawn ^ (drawn >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        drawn = (drawn ^ (drawn >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        drawn ^= drawn >> np.uint64(31)
        count = lambda word: sum(2 * int((word >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes) for b in range(64))
        assert [int(x % 2**64).bit_count() for x in print_.tolist()] == [count(drawn[:, k]) for k in range(3)]


def test_counts_beyond_a_byte():
    hashes = np.arange(1, 3000, dtype=np.uint64)
    owners = np.repeat([0, 1, 2], [700, 1, 2298])
    got = simhash._counted(hashes, owners, 3, 2).reshape(3, 2, -1).sum(2)
    one = [simhash._counted(hashes[i : i + 1], np.zeros(1, int), 1, 2).reshape(2, -1).sum(1) for i in range(len(hashes))]
    assert (got == np.array([sum(one[:700]), one[700], sum(one[701:])])).all()


def test_near_copies_are_found(spark):
    """Recall of the components over planted pairs at least 0.8 alike, and no component over pairs under 0.7."""
    r, texts = random.Random(5), []
    for i in range(300):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 400))]
        near, far = max(1, len(words) // r.choice([46, 60, 90])), len(words) // 10
        texts += [" ".join(words), _edited(r, words, near), _edited(r, words, far)]
    alike = [i for i in range(0, 900, 3) if _alike(texts[i], texts[i + 1]) >= 0.8]
    assert len(alike) > 250 and all(_alike(texts[i], texts[i + 2]) < 0.7 for i in range(0, 900, 3))
    rows = docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], clash=False)
    got = {x["doc_id"] for x in simhash.deduplicated(rows).collect()}
    assert sum(i + 1 not in got for i in alike) >= 0.9 * len(alike)
    assert got >= set(range(0, 900, 3)) | set(range(2, 900, 3))


def test_large_groups_of_near_copies(spark):
    """A group whose members all share keys, two groups that aren't alike but share keys, and texts apart."""
    r = random.Random(7)
    words = [f"w{r.randrange(5000)}" for _ in range(240)]
    other = words[:160] + [f"x{r.randrange(5000)}" for _ in range(80)]
    texts = [_edited(r, w, r.choice([1, 2, 3])) for w in (words, other) for _ in range(40)] + ["", "  ", "one", "One", None]
    rows = docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = sorted(x["doc_id"] for x in simhash.deduplicated(rows).collect())
    assert got == [0, 40, 80, 82]
    assert simhash.deduplicated(docs(spark, [])).collect() == []


def test_crowded_keys_against_one_key(spark):
    """Components are those of all pairs that share a key, keep to the chains and differ little enough."""
    r, texts = random.Random(11), []
    words = [f"w{r.randrange(5000)}" for _ in range(100)]
    for _ in range(70):
        words = _edited(r, words, 2).split()  # a chain: each is alike to those next to it only
        texts.append(" ".join(words))
    width, segments, n = simhash.ring_of(70)
    prints = simhash.long_fingerprints(texts, n)
    bits = np.unpackbits(prints.astype(">i8").view(np.uint8), axis=1)
    label = list(range(70))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(70):
        for j in range(i):
            apart = bits[i] != bits[j]
            if apart.sum() <= int(n * 64 * simhash.DIFFER):
                ring = np.concatenate([apart, apart])
                for s in range(segments):
                    chain = [ring[s * width : (s + k) * width].sum() for k in (1, 2, 3)]
                    if chain[0] == 0 and chain[1] <= int(2 * width * simhash.DIFFER) and chain[2] <= int(3 * width * simhash.DIFFER):
                        label[find(i)] = find(j)
                        break
    rows = docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    least = {}
    for i in range(70):
        least.setdefault(find(i), i)
    assert sorted(x["doc_id"] for x in simhash.deduplicated(rows).collect()) == sorted(least.values())


def _made_by_joins(spark, run):
    """The result of ``run``, and the rows that its inner joins by ``u``, ``v`` or ``ck`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before, rows = {e.executionId() for e in _each(store.executionsList())}, 0
    result = run()
    bus.waitUntilEmpty(30_000)
    for e in _each(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in _each(store.planGraph(e.executionId()).allNodes()):
                if re.search(r"Join \[(u|v|ck)#\S+, \[\w+#\S+, Inner", node.desc()):
                    for m in _each(node.metrics()):
                        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                            rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return result, rows


def test_joins_do_not_broadcast(spark, monkeypatch):
    """Tables that grow with the texts don't go through the driver; without the ids that go, which are bounded, nothing does."""
    monkeypatch.setattr("skylattice.llm.common.BROADCAST_IDS", 0)
    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = [_edited(r, words, r.choice([2, 6, 10])) for _ in range(60)]
    rows = docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], clash=False)
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = {e.executionId() for e in _each(store.executionsList())}
    assert 1 <= simhash.deduplicated(rows).count() < 60
    bus.waitUntilEmpty(30_000)
    plans = [e.physicalPlanDescription() for e in _each(store.executionsList()) if e.executionId() not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_fingerprints_are_joined_by_class(spark):
    """Texts of a loose group share many keys and aren't all alike; fingerprints aren't joined once for each key and text."""
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = [_edited(r, words, r.choice([2, 4, 6, 8, 10])) for _ in range(120)]
    rows = docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], clash=False)
    kept, made = _made_by_joins(spark, lambda: simhash.deduplicated(rows).count())
    assert 1 < kept < 120 and made < 50 * 120


def test_width_follows_the_texts():
    assert simhash.ring_of(0) == simhash.ring_of(130_000) == (20, 80, 25)
    for n in (10**6, 10**9, 10**11):
        width, segments, words = simhash.ring_of(n)
        assert width <= 32 and words * 64 >= width * segments
        assert 1 - (1 - (1 - simhash.AT_ALIKE) ** width) ** segments > 0.94
