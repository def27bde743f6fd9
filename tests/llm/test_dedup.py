import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import components as C
from strandlake.llm import exact_dedup, near_dedup, substring_dedup

from .conftest import corpus

SEPARATORS = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SEPARATORS.split(text or "") if w]


def cut_by_hand(rows, width):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body = split(text)
        gone = [False] * len(body)
        for i in range(len(body) - width + 1):
            window = tuple(body[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(body, gone) if not g)
        out[key] = (len(body), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width, anchor", [(20, 6), (7, 3)])
def test_substring_dedup_against_brute_force(docs_of, width, anchor):
    rows = corpus(width, 72)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs_of(rows), width, anchor).collect()}
    assert got == cut_by_hand(rows, width)


def test_substring_dedup_edges(docs_of, spark):
    once = " ".join(f"w{i}" for i in range(25))
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0
    rows = [(None, once), (1, once), (1, once), (2, once + " " + once), (3, "z " * 50), (4, once.replace("w7", "v7"))]
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(docs_of(rows), texts=True).select("doc_id", "n_removed").collect() if r.doc_id)
    assert got == [(1, 25), (1, 25), (2, 50), (3, 49), (4, 0)]
    null = [r for r in substring_dedup.substring_dedup(docs_of(rows)).collect() if r.doc_id is None]
    assert null[0].n_removed == 0
    alike = [(1, once), (1, once)]
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs_of(alike)).collect()] == [0, 0]


@pytest.mark.parametrize("words", [1, 40])
def test_rows_of_one_id_whose_texts_collide_in_a_short_hash(docs_of, spark, words):
    """Two texts of id 2 have the same 32-bit hash; one has the passage of document 1."""
    passage = " ".join(f"p{i}" for i in range(25))
    rest = " ".join(f"r{i}" for i in range(words - 1))
    one = spark.range(120_000).select(F.concat(F.lit(passage + " q"), "id").alias("a"))
    two = spark.range(120_000).select(F.concat(F.lit((rest + " x").strip()), "id").alias("b"))
    pair = one.join(two, F.hash("a") == F.hash("b")).orderBy("a").first()
    own = " ".join(f"o{i}" for i in range(40))
    rows = [(1, passage), (2, pair.a), (2, pair.b), (3, own)]
    got = substring_dedup.substring_dedup(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == sorted([(1, 25, 0), (2, 26, 25), (2, words, 0), (3, 40, 0)])


def test_substring_dedup_of_very_long_texts(docs_of):
    rng = random.Random(8)
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    middle = " ".join(long_.split()[60_000:60_100])
    rows = [(1, long_), (2, f"a {middle} b"), (3, long_ + " " + middle), (4, "c")]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs_of(rows)).collect()}
    assert got == cut_by_hand(rows, 20)


def test_near_dedup_copies_the_text_of_a_hub(docs_of, spark, monkeypatch):
    """One text with many near copies is compared in parts, none with far more pairs than others."""
    monkeypatch.setattr(near_dedup, "PARTNERS", 8)
    monkeypatch.setattr(near_dedup, "PAIRS", 20)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 1 + i % 59] + [f"x{i}"] + base[2 + i % 59 :])) for i in range(1, 161)] + [(0, " ".join(base))]
    texts = docs_of(rows).select(F.col("doc_id").alias("k"), "text")
    links = near_dedup._Links(texts, None, 5, 85)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 161)], "x long, y long")
    hubs = spark.createDataFrame([("x", 0, 20)], "end string, k long, _parts int")
    dealt = near_dedup._with_text(pairs, texts, hubs, "x", "y", 40)
    loads = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert dealt.count() == 160 and {r.tx for r in dealt.collect()} == {" ".join(base)} and max(loads) < 80
    counts = [near_dedup.common_shingles(*([w.encode() for w in t.split()] for t in (rows[-1][1], r[1])), 5) for r in rows[:-1]]
    want = sum(100 * both >= 85 * (a + b - both) for a, b, both in counts)
    assert 0 < links._judged(pairs).where("linked").count() == want < 160


def test_exact_dedup(docs_of):
    rows = [(5, "a b"), (3, "ab"), (2, "a\n b"), (9, None), (8, ""), (7, " "), (1, "c"), (6, "ä"), (None, "c")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs_of(rows)).collect()}
    assert got[5] == (2, 3, False) and got[3] == (2, 3, False) and got[2] == (2, 3, True)
    assert got[7] == (7, 3, True) and got[8] == (7, 3, False) and got[9] == (7, 3, False)
    assert got[1] == (None, 2, False) and got[None] == (None, 2, True) and got[6] == (6, 1, True)
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(docs_of):
    got = exact_dedup.exact_dedup(docs_of([(1, "a"), (1, "a"), (1, "b")])).collect()
    assert sorted((r.text_sha256[:4], r.kept) for r in got).count((hashlib.sha256(b"a").hexdigest()[:4], True)) == 1
    assert sum(r.kept for r in got) == 2


def test_digest_index_persists(docs_of, spark, tmp_path):
    place = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, place, 4)
    assert sum(r.kept for r in first.add(docs_of([(1, "a"), (2, "b"), (3, "a")])).collect()) == 2
    again = exact_dedup.DigestIndex(spark, place, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(docs_of([(11, "a"), (12, "c"), (13, "c ")])).collect()}
    assert got == {11: (1, False), 12: (13, False), 13: (13, True)}
    assert again.read().count() == 3


def test_digest_index_keeps_its_number_of_buckets(docs_of, spark, tmp_path):
    place = f"file://{tmp_path}/index"
    rows = [(i, f"t{i}") for i in range(200)]
    assert sum(r.kept for r in exact_dedup.exact_dedup(docs_of(rows), place, 8).collect()) == 200
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, place, 4)
    again = exact_dedup.exact_dedup(docs_of(rows), place).collect()
    assert len(again) == 200 and not any(r.kept for r in again)
    with exact_dedup.DigestIndex(spark, place) as index:
        assert index.buckets == 8 and index.read().count() == 200
    assert not [t for t in spark.catalog.listTables() if t.name == index.table]


def test_a_batch_can_be_added_again(docs_of, spark, tmp_path):
    place = f"file://{tmp_path}/index"
    exact_dedup.exact_dedup(docs_of([(1, "a"), (2, "b")]), place, batch="first").collect()
    rows = docs_of([(5, "b"), (7, "c"), (6, "c"), (8, None)])
    once = sorted(tuple(r) for r in exact_dedup.exact_dedup(rows, place, batch="second").collect())
    twice = sorted(tuple(r) for r in exact_dedup.exact_dedup(rows, place, batch="second").collect())
    assert once == twice and {r[0]: r[3] for r in once} == {5: False, 6: True, 7: False, 8: True}


def test_keep_first(docs_of):
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (3, "d"), (3, "c"), (4, None), (5, ""), (None, "e"), (None, "f"), (None, "e "), (6, "a  b"), (7, "d")]
    kept = exact_dedup.keep_first(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(6, "a  b"), (3, "c"), (3, "d"), (4, None), (None, "e "), (None, "f")], key=str)
    assert exact_dedup.keep_first(docs_of([])).count() == 0


def near_by_hand(rows, percent=85):
    sets = {}
    for key, text in rows:
        body = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[key] = {tuple(body[i : i + 5]) for i in range(len(body) - 4)} or ({tuple(body)} if body else set())
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


@pytest.mark.parametrize("block", [4096, 3])
def test_near_dedup_against_brute_force(docs_of, block):
    rows = corpus(11, 96)
    # a long text and versions of it that drift apart: links only between neighbours
    base = [f"b{i}" for i in range(300)]
    for step in range(12):
        base[step * 20 : step * 20 + 3] = [f"c{step}"] * 3
        rows.append((200 + step, " ".join(base)))
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(docs_of(rows), block=block).collect()}
    assert got == near_by_hand(rows)


@pytest.mark.parametrize("others", [9, 12, 45])
def test_near_dedup_reopens_groups_with_all_members(docs_of, others):
    """h is linked to every m, i only to the last m; all pass the sketch and meet in every table."""
    import numpy as np
    import pyarrow as pa

    def signed(*texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["k", "text"])
        return [r for out in near_dedup._signatures(5, near_dedup.SIDE)(batch) for r in out.to_pylist()]

    keys = lambda body: [signed(" ".join(body))[0][c] for c in "ab"]
    # every document has the minhashes of its first 371 words
    base = next(x for n in range(999) if keys(x := [f"b{n}x{i}" for i in range(404)]) == keys(x[:371]))
    want = keys(base)

    def longer(body, names):
        return next(new for name in names if keys(new := [*body, name]) == want)

    i = base[:371]
    for step in range(33):
        i = longer(i, (f"i{step}x{n}" for n in range(99)))
    ms = [longer(base, (f"m{k}x{n}" for n in range(99))) for k in range(others - 1)] + [i[:391]]
    rows = [(k, " ".join(body)) for k, body in enumerate([base, i, *ms])]
    sign = signed(*(text for _, text in rows))
    bits = [np.frombuffer(r["sketch"], np.uint64) for r in sign]
    far = [int(np.bitwise_count(bits[1] ^ b).sum()) for b in bits]
    assert all(185 * d <= 15 * (sign[1]["n"] + r["n"]) for d, r in zip(far, sign))
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(docs_of(rows)).collect()}
    assert got == near_by_hand(rows) and got[1][1] == 0


def test_near_dedup_edges(docs_of):
    assert near_dedup.near_dedup(docs_of([])).count() == 0
    got = near_dedup.near_dedup(docs_of([(None, "a b c"), (3, "A B c"), (4, ""), (5, None)])).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by_id == {None: (1, None, True), 3: (1, None, False), 4: (0, 4, True), 5: (0, 5, True)}


def test_sketch_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 40, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 7 :], rng.integers(0, 2**63, size // 9 + 1, dtype=np.uint64)]))
        x, y = (np.frombuffer(near_dedup.sketch(s), np.uint64) for s in (a, b))
        width = min(len(x), len(y))
        far = np.bitwise_count(near_dedup._folded(x, width) ^ near_dedup._folded(y, width)).sum()
        assert far <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("each", [5, 100_000])
def test_components(spark, monkeypatch, each):
    monkeypatch.setattr(C, "EDGES", each)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (300, 200), (300, 250)]
    df = spark.createDataFrame(edges, "x long, y long").repartition(5)
    got = {r.id: r.root for r in C.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert C.components(df.where("x < 0")).count() == 0


def thue_morse(letters):
    """A word of ``letters`` letters a and b, and its complement: polynomial hashes modulo 2**64
    of the two are equal for every odd base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(letters))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_that_collide_in_polynomial_hashes(docs_of, letters):
    one, other = thue_morse(letters)
    body = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*body[:10], w, *body[10:]])) for i, w in enumerate((one, other))]
    # words a and b in the same two orders
    rows += [(10 + i, " ".join(w)) for i, w in enumerate((one, other))]
    rows += [(20 + i, " ".join(w[:64]) + f" t{i} " + " ".join(body[:4])) for i, w in enumerate((one, other))]
    rows += [(30, f"a b c {one}"), (31, f"a b c {other}"), (32, f"x {one}"), (33, f"x {other}")]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs_of(rows)).collect()}
    assert got == cut_by_hand(rows, 20) and got[1][1] < 41
    found = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(docs_of(rows)).collect()}
    assert found == near_by_hand(rows) and found[31][1] == 31 and found[33][1] == 33


def test_wrong_hashes_remove_and_link_nothing(docs_of, monkeypatch):
    """With hashes of words that nearly always agree, only the words themselves can tell."""
    import numpy as np

    from strandlake.llm import texthash

    lanes = texthash.Chunk.digests
    monkeypatch.setattr(texthash.Chunk, "digests", lambda self, lower=False: lanes(self, lower) & np.uint64(1))
    rows = [(i, t) for i, t in corpus(3, 30) if i % 4]
    batches = {}
    words = lambda key, text: batches.setdefault(key, split(text))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([t for _, t in rows])], ["k", "t", "text"]
    )
    supers = [r for out in substring_dedup._super_edges(7, 3, False)(batch) for r in out.to_pylist()]
    every = [sorted({r["h"] for r in supers if r["k"] == k}) for k, _ in rows]
    batch = pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([[]] * len(rows), pa.list_(pa.int64())), pa.array(every, pa.list_(pa.int64()))], ["k", "t", "text", "whole", "branch"]
    )
    spans = {}
    for out in substring_dedup._confirmed(7, 3)(batch):
        for r in out.to_pylist():
            at, size = r["at"] >> 32, r["at"] & 0xFFFFFFFF
            assert size == 1
            body = words(r["k"], dict(rows)[r["k"]])[at : at + 7]
            assert spans.setdefault((r["s1"], r["s2"]), body) == body
    assert spans


def test_common_shingles_are_exact():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(0, 14))] for _ in "ab")
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (a, b)]
        assert near_dedup.common_shingles(a, b, 5) == (len(sets[0]), len(sets[1]), len(sets[0] & sets[1]))


def test_many_rows_without_an_id(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text + f" x{i % 7}") for i in range(300)] + [(1, text), (2, "y " + text)]
    got = substring_dedup.substring_dedup(docs_of(rows)).collect()
    assert len(got) == 302 and all(r.n_removed == (0 if r.doc_id is None else 60) for r in got)


def test_large_groups_of_near_copies(docs_of):
    """Buckets of several slices: copies, and two families that only differ across slices."""
    base = [f"g{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"e{i}"])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:30], *[f"h{n}" for n in range(70)], f"e{i}"])) for i in range(25)]
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(docs_of(rows), block=6).collect()}
    assert got == near_by_hand(rows)


@pytest.mark.parametrize("size", [1, 400, 10**6])
def test_linked_members_join_what_exact_sets_link(monkeypatch, size):
    """Groups compared whole, in blocks of texts: a forest with the components of all links."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "TEXT_BYTES", size)
    rng = random.Random(5)
    bodies, base = [], [f"b{i}" for i in range(60)]
    for i in range(40):
        base[rng.randrange(60)] = f"n{i}"
        bodies.append(list(base) if i % 7 else ["x"] * (i // 14 + 1))
    # members 3, 4 and 5 count as linked before
    labels = np.array([3 if i in (4, 5) else i for i in range(40)])
    forest = near_dedup.linked_members(list(range(40)), labels, [[w.encode() for w in b] for b in bodies], 5, 85)
    sets = [{tuple(b[i : i + 5]) for i in range(len(b) - 4)} or {tuple(b)} for b in bodies]
    links = {(i, j) for j in range(40) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}

    def parts(edges):
        up = labels.copy()
        for i, j in edges:
            up[up == up[j]] = up[i]
        return {frozenset(np.flatnonzero(up == r).tolist()) for r in up}

    assert {tuple(sorted(e)) for e in forest} <= links and parts(forest) == parts(links)
    assert len(forest) == len(set(labels.tolist())) - len(parts(links))


@pytest.mark.parametrize("sizes", [(2000, 3), (900, 700, 1), (600, *[1] * 150)])
def test_across_slices_the_largest_component_goes_along_once(spark, sizes):
    """Every two members of different components meet, in rows that grow with the members and not
    with their square where one component is nearly all of a bucket."""
    label = [i for i, n in enumerate(sizes) for _ in range(n)]
    rows = [(7, i, 0, 4, x) for i, x in enumerate(label)]
    units = near_dedup._across(spark.createDataFrame(rows, "key long, id long, half long, slices long, label long"), 100).collect()
    if sizes == (2000, 3):
        assert len(units) == 2000 + 3 * 21
    met = {}
    for r in units:
        met.setdefault((r.p, r.q), []).append((r.id, r.half))
    assert max(map(len, met.values())) <= 300
    pairs = np.zeros((len(label),) * 2, bool)
    for (p, q), found in met.items():
        ids, half = (np.array(x) for x in zip(*found))
        pairs[np.ix_(ids, ids)] |= (half[:, None] != half[None, :]) | (p == q)
    names = np.array(label)
    assert pairs[names[:, None] != names[None, :]].all()


def test_a_family_of_near_copies_is_sliced_once_for_all_tables(spark):
    """Members that meet in many large buckets have a few rows each, whatever their number is, and
    all pairs that met in a bucket still meet; a bucket that overlaps with no other stays."""
    rng, side, block = random.Random(4), 10, 20
    for members in (200, 400):
        near = [(i, [rng.randrange(2) for _ in range(side)], [rng.randrange(2) for _ in range(side)]) for i in range(members)]
        alone = [(1000 + i, [10 * i + n for n in range(90, 90 + side)], [7] + [9 * i + n for n in range(9000, 8999 + side)]) for i in range(130)]
        alone = [(k, [8, *a[1:]], b) for k, a, b in alone]
        reps = spark.createDataFrame(near + alone, "id long, a array<long>, b array<long>")
        rows = near_dedup._buckets(reps, side, block).collect()
        own = [r for r in rows if r.id < 1000]
        # a member has 40 tables, and about a quarter of all meet it in each
        assert len(own) == near_dedup.SLICINGS * members and sum(r.across for r in own) == members
        assert len({r.key for r in own if r.across}) == 1
        assert {r.id for r in rows if r.across and r.id >= 1000} == {k for k, _, _ in alone}
        sizes = {}
        for r in own:
            sizes[r.key, r.half] = sizes.get((r.key, r.half), 0) + 1
        assert max(sizes.values()) <= 2 * block
