import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandlake.llm import licenses, mixing, packing, pii, quality, toxicity
from strandlake.llm import progressive_jpeg as jpeg

from .conftest import corpus

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")
DATA = Path("/root/testdata/sf0.001")


# -- personal data


def digits(text):
    return re.sub("[^0-9]", "", text)


def rules_by_pattern(text):
    found = lambda p: list(re.finditer(p, text))
    return {
        "email": [m.span() for m in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in found(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in found(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15],
    }


def test_rules_equal_patterns():
    rng = random.Random(3)
    pieces = ["a.b@c.de", "x@y", "@", "+", "+1 (234) 555-0000", "4111 1111 1111 1111", "10.0.0.256", "1.2.3.4.5", "é", " ", "-", "12", ".", "4111-1111-1111-1112", "+12345", "q@r.s@t.u"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.strict(text) == rules_by_pattern(text), text


def test_many_spans_in_one_text():
    text = "call (212) 555-0123 now, or a.b@c.de; " * 20_000 + "7" * 200_000
    base, more = pii.find(text, pii.trained())
    assert len(base["email"]) == 20_000 and len(more["phone"]) == 20_000
    spans = sorted(s for found in (base, more) for kind in found.values() for s in kind)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_pii_columns(docs_of):
    rows = [(1, "é mail a.b@c.de or +1 (234) 555-0000"), (2, None), (3, ""), (None, "10.0.0.1"), (5, "call (212) 555-0123 now"), (6, "0" * 5000 + ".1.2.3")]
    got = {r.doc_id: r for r in pii.find_pii(docs_of(rows), texts=True).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].spans) == (1, 1, "email:7:15,phone:19:36")
    assert got[1].base_sha256 == hashlib.sha256(b"email:7:15,phone:19:36").hexdigest()
    assert got[1].redacted == "é mail [EMAIL] or [PHONE]"
    assert got[2].spans == got[3].spans == "" and got[None].n_ip == 1
    assert got[5].n_phone == 0 and got[5].spans == "phone:5:19" and got[5].n_added == 1
    assert got[6].n_ip == 1 and pii.find_pii(docs_of([])).count() == 0


@pytest.mark.parametrize("unseen", [False, True])
def test_boosted_trees_find_items_planted_in_documents(unseen):
    """Items go into real texts at random places; with ``unseen`` in formats that training lacks."""
    pandas = pytest.importorskip("pandas")
    if not DATA.exists():
        pytest.skip("the given tables are not here")
    texts = [t for t in pandas.read_parquet(DATA / "documents.parquet").text if t and " " in t]
    model, rng = pii.trained(), random.Random(99)
    clean = sum(len(spans) for t in texts for spans in pii.find(t, model)[1].values())
    planted = {k: [0, 0] for k in range(4)}
    decoys = [0, 0]
    for i in range(800):
        text, kind = texts[i % len(texts)], rng.choice([0, 1, 2, 3, -1])
        blanks = [j for j, c in enumerate(text) if c == " "]
        at = rng.choice(blanks) + 1
        item = pii._item(rng, kind, unseen)
        base, more = pii.find(text[:at] + item + text[at - 1 :], model)
        near = [(k, a, b) for part in (base, more) for k, spans in part.items() for a, b in spans if a < at + len(item) and b > at]
        if kind < 0:
            decoys[0] += 1
            decoys[1] += any((a, b) in more[k] for k, a, b in near)
        else:
            planted[kind][0] += 1
            planted[kind][1] += any(k == pii.KINDS[kind] and b - a >= 0.45 * len(item) for k, a, b in near)
    assert all(found >= 0.9 * n for n, found in planted.values()), planted
    assert decoys[1] <= 0.06 * decoys[0], decoys
    assert clean <= 0.002 * len(texts)


def test_candidates_overlap_and_cards_stand_apart_from_their_neighbours():
    card = next(c for c in (f"453201511283{n:04}" for n in range(9999)) if pii.luhn(c))
    text = f"from 2353820953013741 {card} on"
    base, more = pii.find(text, pii.trained())
    assert not any(base.values()) and more["card"] == [(22, 38)]
    spans = pii.candidates("call (212) 555-0123 4111 1111 1111 1111 now")
    assert any(a < y and x < b and (a, b) != (x, y) for _, a, b in spans for _, x, y in spans)
    assert pii.candidates("JANE [AT] EXAMPLE.COM") and pii.candidates("jane at example dot com") and not pii.candidates("he was at home. Then")


# -- media


def test_payload_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 4000, 100_000):
        text = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        payload = jpeg.payload_for(text).tobytes()
        assert len(payload) % 64 == 0 and payload[:n] == text and not any(payload[n:])
        assert jpeg.payload_of(jpeg.decode(jpeg.encode(np.frombuffer(payload, np.uint8)))) == payload


class Writer:
    """Bits and Huffman codes of a sparse progressive file, one symbol at a time."""

    def __init__(self, lengths):
        self.bits = []
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        self.codes, code, last = {}, 0, 0
        for s in order:
            code <<= lengths[s] - last
            last = lengths[s]
            self.codes[s] = (code, last)
            code += 1

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(*self.codes[s])

    def body(self):
        return jpeg._packed(np.array(self.bits, np.uint8))


def magnitude(v):
    v = int(v)
    size = abs(v).bit_length()
    return size, v if v > 0 else v + (1 << size) - 1


def test_sparse_scans_read_symbol_by_symbol():
    """A grey 24 x 16 image: DC differences, zero runs, end-of-band runs, refinements."""
    rng = random.Random(6)
    blocks = np.zeros((6, 64), int)
    for b in range(6):
        blocks[b, 0] = rng.randrange(-200, 200)
        for _ in range(rng.randrange(0, 9)):
            blocks[b, rng.randrange(1, 64)] = rng.choice([-9, -5, -3, -2, -1, 1, 2, 3, 5, 8])
    blocks[2, 1:] = 0
    blocks[4, 1:] = 0
    blocks[4, 60] = 3
    dc = {s: 8 for s in range(12)}
    ac = {r << 4 | s: 10 for r in range(16) for s in range(11)}
    first = Writer(dc)
    last = 0
    for b in blocks:
        size, extra = magnitude((b[0] >> 1) - last)
        first.symbol(size)
        first.put(extra, size)
        last = b[0] >> 1
    second = Writer(dc)
    for b in blocks:
        second.put(int(b[0]) & 1, 1)
    low = Writer(ac)  # bits from 1 up, all bands
    down = lambda v: int(np.sign(v)) * (abs(int(v)) >> 1)
    for b in blocks:
        run = 0
        for k in range(1, 64):
            v = down(b[k])
            if not v:
                run += 1
                continue
            while run > 15:
                low.symbol(0xF0)
                run -= 16
            size, extra = magnitude(v)
            low.symbol(run << 4 | size)
            low.put(extra, size)
            run = 0
        if run:
            low.symbol(0)
    fine = Writer(ac)
    for b in blocks:
        run, held = 0, []
        new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        for k in range(1, 64):
            v = int(b[k])
            if down(v):
                held.append(abs(v) & 1)
            elif abs(v) == 1:
                fine.symbol(run << 4 | 1)
                fine.put(int(v > 0), 1)
                fine.bits += held
                run, held = 0, []
            elif new and k < new[-1]:
                if run == 15:
                    fine.symbol(0xF0)
                    fine.bits += held
                    run, held = 0, []
                else:
                    run += 1
        if not new or new[-1] < 63:
            fine.symbol(0)
            fine.bits += held
    frame = bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0])
    data = b"".join(
        [
            b"\xff\xd8",
            jpeg._segment(0xDB, b"\x00" + b"\x02" * 64),
            jpeg._segment(0xC2, frame),
            jpeg._table(0x00, dc),
            jpeg._table(0x10, ac),
            jpeg._scan([(1, 0)], 0, 0, 0, 1, first.body()),
            jpeg._scan([(1, 0)], 1, 63, 0, 1, low.body()),
            jpeg._scan([(1, 0)], 0, 0, 1, 0, second.body()),
            jpeg._scan([(1, 0)], 1, 63, 1, 0, fine.body()),
            b"\xff\xd9",
        ]
    )
    image = jpeg.decode(data)
    assert (image.components[0].coefficients == blocks).all()
    # the inverse transform against its definition
    x = np.arange(8)
    basis = np.where(x[None, :] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16)
    natural = np.zeros(64)
    natural[jpeg._ZIGZAG] = blocks[1] * 2
    want = basis @ natural.reshape(8, 8) @ basis.T
    assert np.abs(jpeg.planes(image)[0][:8, 8:16] - want).max() <= 1.0
    rgb = jpeg.to_rgb(image)
    assert rgb.shape == (16, 24, 3) and (rgb[:, :, 0] == rgb[:, :, 2]).all()


def test_media_columns(docs_of):
    rows = corpus(2, 12)
    got = {r.doc_id: r for r in jpeg.media(docs_of(rows), tensors=True).collect()}
    for key, text in rows:
        data = (text or "").encode()
        payload = jpeg.payload_for(data).tobytes()
        r = got[key]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert len(r.rgb) == 3 * r.height * r.width
    again = jpeg.decode_media(jpeg.media(docs_of(rows), tensors=True)).collect()
    assert all(got[r.doc_id].rgb == r.rgb for r in again)
    assert jpeg.media(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        jpeg.decode(b"no")


# -- packing


def check_pieces(rows, pieces, limits, ids_of):
    per_document, per_sequence = {}, {}
    for p in pieces:
        per_document.setdefault(p.doc_id, []).append(p)
        per_sequence.setdefault(p.sequence_id, []).append(p)
    for key, text in rows:
        ids, at = ids_of(text), 0
        for p in sorted(per_document[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in per_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == limits.tokens or at & (at - 1) == 0
        assert len(parts) <= limits.segments


def test_packing(docs_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    odd = "Don't <|endoftext|>x <|ENDOFTEXT|> \x1c b c é ÀÉ, ªb. q.,. BAZ*** 12ab 　z"
    rows = corpus(4, 40) + [(500, odd), (501, "long word " * 900), (502, "a," * 30)]
    ids_of = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END])
    for limits in (packing.Limits(), packing.Limits(64, 8, 64)):
        pieces = packing.pack(docs_of(rows), PATH, limits, window=500).collect()
        check_pieces(rows, pieces, limits, ids_of)
    assert packing.pack(docs_of([]), PATH).count() == 0
    assert [r.doc_id for r in packing.pack(docs_of([(None, "a")]), PATH).collect()] == [None]


def test_packing_keeps_loss_limit(docs_of):
    rows = [(i, "one two three four five") for i in range(40)]
    df = docs_of(rows).withColumn("answer", F.col("doc_id") % 2 == 0)
    limits = packing.Limits(64, 32, 16)
    pieces = packing.pack(df, PATH, limits, trained="answer").collect()
    loss = {}
    for p in pieces:
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + p.length * (p.doc_id % 2 == 0)
    assert max(loss.values()) <= 16 and sum(p.length for p in pieces) == 240


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 8, 64), packing.Limits(64, 100, 24)])
def test_packer_places_by_the_dot_product(limits):
    """Against a plain loop that scores every piece for every place, up to the first piece that
    has to be cut."""
    rng = random.Random(limits.tokens + limits.loss_tokens)
    packer = packing.Packer(limits, 10**9, 0)
    sizes = [(rng.randrange(1, min(limits.loss_tokens, limits.tokens) + 1), rng.random() < 0.5) for _ in range(300)]
    for i, (n, bears) in enumerate(sizes):
        packer.add(i, np.full(n, 7, "<u4"), bears)
    full, pieces = limits.vector(), [p for stack in packer.stacks.values() for p in stack]
    left, want = full.copy(), []
    while True:
        fits = [p for p in pieces if all(d <= r for d, r in zip((p[2], 1, p[2] * p[4]), left))]
        if not fits:
            break
        score = lambda p: (p[2] * left[0] / full[0] ** 2) + left[1] / full[1] ** 2 + p[2] * p[4] * left[2] / full[2] ** 2
        best = max(map(score, fits))
        pick = next(p for p in fits if score(p) > best - 1e-12)
        pieces = [p for p in pieces if p is not pick]
        left -= (pick[2], 1, pick[2] * pick[4])
        want.append((pick[2], pick[4]))
    got, room = [], full.copy()
    while (found := packer._best(room)) is not None:
        for _ in range(found[1]):
            piece = packer._take(found[0])
            room -= (piece[2], 1, piece[2] * piece[4])
            got.append((piece[2], piece[4]))
    assert got == want


def test_packing_very_many_short_documents_takes_seconds():
    began = time.perf_counter()
    packer = packing.Packer(packing.Limits(), 1_000_000, 0)
    one = np.array([packing.END], "<u4")
    total = 0
    for i in range(300_000):
        packer.add(i, one, True)
        total += len(packer.taken()) if i % 50_000 == 0 else 0
    packer.finish()
    rest = packer.taken()
    assert total + len(rest) == 300_000 and time.perf_counter() - began < 30
    with pytest.raises(ValueError):
        packing.Limits(loss_tokens=0)
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)


def test_conversations_meet_three_limits(spark):
    from strandlake.llm import queries

    if not DATA.exists():
        pytest.skip("the given tables are not here")
    pieces = queries.pack_conversations(spark, str(DATA.parent / "sf0.01"))
    row = packing.padding(pieces, queries.CONVERSATION_LIMITS).first()
    limits = queries.CONVERSATION_LIMITS
    assert row.most_loss == limits.loss_tokens and row.most_segments == limits.segments and row.padding == 0
    both = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss"))
    assert both.where(f"n > {limits.tokens} or loss > {limits.loss_tokens}").count() == 0


# -- mixing


def test_mixing_meets_its_targets(docs_of, spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 30)) for i in range(300)] + [(None, "z"), (4, None), (7, "a b"), (7, "a b")]
    df = docs_of(rows).withColumn("source", F.when(F.col("doc_id") < 200, "big").when(F.col("doc_id") < 260, "mid").otherwise(F.col("source")))
    totals = {r.s: r.t for r in mixing.measure(df).groupBy("s").agg(F.sum("tokens").alias("t")).collect()}
    target = mixing.Target(max_repetition=2.0, block_tokens=200)
    got = mixing.mix(df, target).collect()
    planned = {r.s: r for r in mixing.plan(mixing.measure(df), target).collect()}
    passes = {s: planned[s].wanted / totals[s] for s in totals}
    assert max(passes.values()) <= 2.01 and min(passes.values()) >= 0.99
    for s, total in totals.items():
        name = None if s == "\x00" else s
        mine = [r for r in got if r.source == name]
        spent = sum(r.tokens for r in mine)
        assert spent <= planned[s].wanted < spent + 80
        places = sorted((r.epoch, r.block, r.position) for r in mine)
        assert len(set(places)) == len(places)
        whole = [r for r in mine if r.epoch < planned[s].passes]
        assert sum(r.tokens for r in whole) == planned[s].passes * total
    assert mixing.mixed_documents(df, target).count() == len(got)
    assert mixing.mixed_documents(df, target).columns == df.columns


def test_exponent(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "s string, total long")
    p = np.array([0.9, 0.09, 0.01])
    a = mixing.exponent(totals, mixing.Target(entropy=0.8))
    w = p**a / (p**a).sum()
    assert abs(-(w * np.log(w)).sum() - 0.8) < 1e-4
    b = mixing.exponent(totals, mixing.Target(max_repetition=3.0))
    assert abs(90.0 ** (1 - b) - 3.0) < 1e-3
    c = mixing.exponent(totals, mixing.Target(max_repetition=3.0, budget=1000))
    w = p**c / (p**c).sum()
    assert abs((w / p).max() - 3.0) < 1e-3
    assert mixing.exponent(totals, mixing.Target(entropy=0.01)) == 1.0 and mixing.exponent(totals, mixing.Target(entropy=9.0)) == 0.0
    assert mixing.exponent(totals, mixing.Target()) == 1.0
    assert mixing.exponent(totals.limit(0), mixing.Target(entropy=1.0)) == 1.0


def test_mixing_of_nothing(docs_of):
    assert mixing.mix(docs_of([]), mixing.Target(max_repetition=2.0)).count() == 0


# -- classifiers


def test_quality_learns_and_holds(docs_of, spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, " ".join(word() + ("" if good else "###") for _ in range(40))))
        marks.append((i, int(good), None))
    labels = spark.createDataFrame(marks + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs_of(rows + [(None, None), (1000, "")]), labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert all(got[i].predicted == (i % 3 > 0) for i in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].score == got[1000].score
    kept = quality.keep_good(docs_of(rows), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if got[i].predicted} and "digest" in kept.columns
    none = labels.where("quality > 1")
    assert {r.score for r in quality.classify(docs_of(rows[:3]), none).collect()} == {0.5}
    assert quality.classify(docs_of([]), labels).count() == 0


def test_isotonic():
    raw, calibrated = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(raw) > 0).all() and (np.diff(calibrated) >= 0).all() and 0 < calibrated[0] < calibrated[-1] < 1


def test_toxicity_moments_and_risk_against_rows(spark):
    """Sums over tasks give the risk that a loop over all rows gives."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.3).astype("<u2") for _ in range(200)]
    df = spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "members binary").repartition(5)
    n, pairs = toxicity.moments(df, 6)
    table = np.zeros((200, 7))
    table[:, 6] = 1
    for i, r in enumerate(rows):
        table[i, r] = 1
    assert n == 200 and np.allclose(toxicity._quadratic(n, pairs), table.T @ table / 200)
    toxic, prior = table[:40], 0.2
    w = rng.normal(size=7)
    loss = lambda x, y: ((1 - y * (x @ w)) ** 2 / 4).mean()
    got = toxicity.risks(w, toxic.T @ toxic / 40, table.T @ table / 200, prior)
    assert np.allclose(got, (prior * loss(toxic, 1), loss(table, -1) - prior * loss(toxic, -1)))
    best = toxicity.train(toxic.T @ toxic / 40, table.T @ table / 200, prior)
    total = lambda v: sum(max(0.0, x) if i else x for i, x in enumerate(toxicity.risks(v, toxic.T @ toxic / 40, table.T @ table / 200, prior)))
    assert total(best) <= total(np.eye(7)[6] * (2 * prior - 1)) + 1e-9


def test_toxicity_finds_frequent_prefixes(docs_of, spark):
    """Words of one prefix occur now and then everywhere, and often in toxic texts."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(900):
        body = [word() for _ in range(100)] + ["quorx" + word() for _ in range(4 if i % 6 == 0 else rng.random() < 0.2)]
        rng.shuffle(body)
        rows.append((i, " ".join(body)))
    labels = spark.createDataFrame([(i, None, int(i % 6 == 0)) for i in range(900) if i % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs_of(rows), labels).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted for i in held if i % 6 == 0) >= 0.9 * sum(i % 6 == 0 for i in held)
    assert sum(got[i].predicted for i in held if i % 6) <= 0.03 * len(held)


def test_toxicity_learns_from_positives(docs_of, spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        body = [word() for _ in range(40)] + rng.sample(["grobian", "lumpazi", "schuft"], 2) * bad
        rng.shuffle(body)
        rows.append((i, " ".join(body)))
        if i % 2 == 0:
            marks.append((i, None, int(bad)))
    labels = spark.createDataFrame(marks + [(7, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs_of(rows + [(None, None), (1000, "")]), labels).collect()}
    held = [i for i in range(900) if got[i].held_out]
    hits = sum(got[i].predicted for i in held if i % 6 == 0) / sum(i % 6 == 0 for i in held)
    false = sum(got[i].predicted for i in held if i % 6) / sum(i % 6 > 0 for i in held)
    assert hits > 0.95 and false < 0.02 and got[None].predicted == got[1000].predicted == 0
    none = labels.where("toxic = 0")
    assert {r.score for r in toxicity.classify(docs_of(rows[:3]), none).collect()} == {0.0}
    assert toxicity.classify(docs_of([]), labels).count() == 0


# -- licences


@pytest.mark.parametrize("hot_share", [1000, 3, 1])
def test_licence_scan(spark, hot_share):
    rows = [
        ("a/LICENSE", 1, "Released under the MIT License."),
        ("a/x.py", 2, "code\nmore"),
        ("a/b/y.py", 3, "Licensed under the Apache License, Version 2.0.\n" + "code " * 50),
        ("a/b/c/z.py", 4, None),
        ("d/w.py", 5, ""),
        (None, 6, "some words about a licence of poets and other people in a long line"),
        ("a/b/COPYING", None, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ]
    df = spark.createDataFrame([(p, i, t, "x") for p, i, t in rows], "path string, doc_id long, text string, term string")
    got = {r.doc_id: r for r in licenses.scan(df, F.col("path"), hot_share=hot_share).collect()}
    assert len(got) == 7
    assert got[1].own_licence == "MIT" and got[2].licence == "MIT" and got[2].inherited_from == "a"
    assert got[3].licence == "Apache-2.0" and got[3].inherited_from is None
    assert got[None].own_licence == "GPL-3.0"
    assert got[4].licence == "GPL-3.0" and got[4].inherited_from == "a/b"
    assert got[5].licence is None and got[6].own_licence is None
    assert licenses.scan(df.limit(0), F.col("path")).count() == 0


def test_licence_files_of_many_lines(spark):
    texts = licenses.full_texts()
    rows = [(f"{name}/LICENSE", i, text.replace("<year> <holders>", "2020 A. Person")) for i, (name, text) in enumerate(texts.items())]
    rows += [(f"{name}/src/x.py", 100 + i, "x = 1") for i, name in enumerate(texts)]
    rows.append(("code/x.py", 200, texts["MIT"] + "\n" + "some code\n" * 200))
    rows.append(("code/y.py", 201, "y = 1"))
    df = spark.createDataFrame(rows, "path string, doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, F.col("path")).collect()}
    for i, name in enumerate(texts):
        assert got[i].own_licence == name
        assert (got[100 + i].licence, got[100 + i].inherited_from) == (name, name)
    assert got[200].own_licence == "MIT" and got[201].licence is None


def test_each_licence_template_finds_itself_whole_and_wrapped(spark):
    rows, want = [], {}
    for name, bodies in licenses.TEMPLATES.items():
        for body in bodies:
            said = body.split()
            for per in (99, len(said) // 2 + 1, 5, 1):
                want[len(rows)] = name
                lines = [" * " + " ".join(said[i : i + per]) for i in range(0, len(said), per)]
                rows.append((f"p/{len(rows)}", len(rows), "\n".join(["int x;"] * 40 + lines + ["int y;"] * 40)))
    df = spark.createDataFrame(rows, "path string, doc_id long, text string")
    assert {r.doc_id: r.own_licence for r in licenses.scan(df, F.col("path")).collect()} == want


def test_workers_forget_other_kinds():
    from strandlake.llm import common

    def nothing(batches):
        common.remembered("other")["b"] = 2
        yield from batches

    common.remembered("mine")["a"] = 1
    assert list(common.released(nothing, "mine")(iter([5]))) == [5]
    assert common.remembered("mine") == {"a": 1} and common.remembered("other") == {}
    list(common.released(nothing)(iter([])))
    assert common.remembered("mine") == {}
