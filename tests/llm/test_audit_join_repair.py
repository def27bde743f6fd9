"""Source divergence, the metric join and turn repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import metric_join, source_divergence, turn_repair

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def audit_by_hand(rows, min_docs=3, top=200):
    """(lang, source, part, item, value, rank) of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, Counter(TERM.findall(t.translate(FOLD)))) for la, s, t in rows if la == lang]
        docs = Counter(t for _, c in mine for t in c)
        kept = {t for t, n in docs.items() if n >= min_docs}
        groups = {s: Counter() for s, _ in mine}
        every = Counter()
        for s, c in mine:
            own = {t: n for t, n in c.items() if t in kept}
            groups[s].update(own)
            every.update(own)

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in groups.items():
            pairs = [(sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), h) for h, o in groups.items() if h != s]
            terms = [((share(c, t) - share(every, t)) ** 2 // share(every, t), t) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found[:most])]
    return sorted(out)


def divergence_rows(seed, n=90, sources=6, words=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = f"s{rng.randrange(sources)}" if i % 3 else "hot"
        body = [f"{rng.choice('abcdefgh')}{rng.choice('xyzäÖ')}" * rng.randrange(1, 3) for _ in range(rng.randrange(0, words))]
        rows.append((rng.choice(["en", "de"]), source, rng.choice([" ", "1", "_", "—x "]).join(body)))
    rows += [("fr", "lone", "une deux"), ("fr", "other", ""), ("fr", None, None), (None, None, None), ("", "s1", "ÉÀ Éa \x00b"), (None, "s2", "Éa Éa"), ("", "", "Éa")]
    return rows


def audited(spark, rows, **limits):
    df = spark.createDataFrame([(*r, 7, "t", None) for r in rows], "lang string, source string, text string, n int, term string, value string").repartition(4)
    return sorted(tuple(r) for r in source_divergence.audit(df, **limits).collect())


@pytest.mark.parametrize("heavy", [1, 3, 100])
def test_audit_equals_brute_force_at_any_split(spark, heavy):
    rows = divergence_rows(heavy)
    assert audited(spark, rows, heavy=heavy) == audit_by_hand(rows)


def test_audit_of_many_groups_uses_several_tiles(spark):
    rows = divergence_rows(11, n=150, sources=10)
    assert audited(spark, rows, heavy=2, top=5, side=3, tile_terms=10) == audit_by_hand(rows, top=5)


def test_audit_of_long_repeated_and_no_texts(spark):
    long_ = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(30_000))
    rows = [("en", "a", long_), ("en", "a", long_), ("en", "b", long_ + " wzz wzz"), ("en", "b", "waa waa")] * 2
    # counts leave a task in many parts
    assert audited(spark, rows, held=50) == audit_by_hand(rows)
    assert audited(spark, [("en", "a", "1 2"), ("en", "b", "")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, []) == []


def test_shares_do_not_overflow():
    n, of = np.array([10**13, 0]), np.array([4 * 10**13, 4 * 10**13])
    assert source_divergence.shares(n, of).tolist() == [1 + 10**9 * (10**13 + 1) // (4 * 10**13), 1]


# vectors


def joined_by_hand(rows, limit):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label)."""

    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, x, la), (b, y, lb) = rows[i], rows[j]
        if la is not None and la == lb and fit(x) and fit(y) and len(x) == len(y):
            dot, one, two = (math.fsum(p * q for p, q in zip(s, t)) for s, t in ((x, y), (x, x), (y, y)))
            if dot / math.sqrt(one) / math.sqrt(two) >= limit:
                links[i].append(j)
                links[j].append(i)
    root = {r[0]: r[0] for r in rows}
    low = lambda a: -math.inf if a is None else a
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            for j in own:
                best = min(root[rows[i][0]], root[rows[j][0]], key=low)
                for k in (i, j):
                    if root[rows[k][0]] != best:
                        root[rows[k][0]] = best
                        changed = True
    return sorted(((r[0], len(own), root[r[0]], r[0] == root[r[0]]) for r, own in zip(rows, links)), key=str)


def joined(spark, rows, limit=0.98, block=2048):
    df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, la, "x", 3) for i, v, la in rows], "vec_id long, embedding array<double>, label int, cell string, u long")
    return sorted((tuple(r) for r in metric_join.near_vectors(df.repartition(3), limit, block=block).collect()), key=str)


def clusters(seed, n=300, dims=5, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = centres[0] + rng.normal(size=dims) * 0.01  # one large group of near copies
        elif i % 7 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1])
        else:
            v = centres[rng.integers(12)] + rng.normal(size=dims) * spread
        rows.append((int(i * 5 % 1009), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block,limit", [(2048, 0.98), (10, 0.98), (10, 0.9), (25, 0.995)])
def test_metric_join_equals_brute_force(spark, block, limit):
    rows = clusters(block)
    assert joined(spark, rows, limit, block) == joined_by_hand(rows, limit)


def test_metric_join_parts_cells_and_skips_cores(spark, monkeypatch):
    """Parting has to have happened, to many guests and cores."""
    made = []
    plain = metric_join._chosen
    monkeypatch.setattr(metric_join, "materialize", lambda df, name: made.append((name, found := metric_join_materialize(df, name))) or found)
    metric_join_materialize = __import__("strandlake.llm.common", fromlist=["materialize"]).materialize
    rows = clusters(3, n=600)
    assert joined(spark, rows, 0.98, 10) == joined_by_hand(rows, 0.98)
    state = next(df for name, df in made if name == "joined")
    assert state.where("near").count() > 50 and state.where("not home").count() > 50 and plain is metric_join._chosen


def test_metric_join_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1, 0], 1), (2, [2, 0], 1), (3, [1, 0], 2), (4, [1, 0], None), (5, None, 1), (6, [], 1), (7, [0, 0], 1), (8, [nan, 1], 1), (9, [inf, 1], 1),
        (10, [None, 1], 1), (11, [1, 0, 0], 1), (12, [1e200, 1e100], 1), (13, [1e-200, 0], 1), (None, [1, 0.01], 1), (None, [0, 1], 1), (14, [0, 1.0], 1), (14, [-1, 0], 2), (15, [-1, -0.0], 2), (15, [-1, 0.0], 2),
    ]
    found = joined(spark, rows)
    # vectors far from 1 are scaled by hand, which changes no cosine
    plain = [(i, [x / 1e200 for x in v] if i == 12 else [x * 1e200 for x in v] if i == 13 else v, la) for i, v, la in rows]
    assert found == joined_by_hand(plain, 0.98)
    assert joined(spark, []) == []


# conversations


def least_edits(rows):
    """(cost, audit, lines) of (role, text, fault), by strings and without limits on what is kept."""
    best = {0: (0, "", ())}
    name = {2: "user", 3: "assistant"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(states):
        for _ in range(4):
            for s, (c, a, ls) in list(states.items()):
                new = (c + 2, a + "I", (*ls, f"{name[after[s]]}:"))
                if new[:2] < states.get(after[s], (math.inf, ""))[:2]:
                    states[after[s]] = new
        return states

    # prefixes that end in a different number of insertions compare by what follows, so all are tried
    paths = [(0, 0, "", ())]
    for role, text, fault in rows:
        found = {}
        for s, c, a, ls in paths:
            for run in range(4):
                t, more = s, ls
                for _ in range(run):
                    t = after[t]
                    more = (*more, f"{name[t]}:")
                options = [("D", t, 3, more)]
                if fault not in ("blank", "duplicate"):
                    extra = int(fault == "truncated")
                    options.append(("R", after[t], 2 + extra, (*more, f"{name[after[t]]}:{text}")))
                    if role[:1] == "s" and t == 0:
                        options.append(("K", 1, extra, (*more, f"{role}:{text}")))
                    if role[:1] == name[after[t]][0]:
                        options.append(("K", after[t], extra, (*more, f"{role}:{text}")))
                for letter, to, price, lines in options:
                    new = (c + 2 * run + price, a + "I" * run + letter, lines)
                    if to not in found or new[:2] < found[to][:2]:
                        found[to] = new
        paths = [(s, *v) for s, v in found.items()]
    ends = []
    for s, c, a, ls in paths:
        for run in range(4):
            t, more = s, ls
            for _ in range(run):
                t = after[t]
                more = (*more, f"{name[t]}:")
            if t in (0, 3):
                ends.append((c + 2 * run, a + "I" * run, more))
    assert inserted(best)
    return min(ends, key=lambda e: e[:2])


def every_edit(rows):
    """The same by trying every sequence of edits with up to two insertions before each row."""
    pattern = re.compile(r"^(s?(ua)+)?$")
    best = None
    for runs in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            choices = []
            cost, audit = 0, ""
            for run, edit, (role, text, fault) in zip(runs, edits, rows):
                audit += "I" * run + edit
                cost += 2 * run + {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and fault == "truncated")
                choices += [("u", "a")] * run
                if edit != "D":
                    if fault in ("blank", "duplicate"):
                        break
                    choices.append(("u", "a") if edit == "R" else (role[:1] or "-",))
            else:
                audit += "I" * runs[-1]
                cost += 2 * runs[-1]
                choices += [("u", "a")] * runs[-1]
                if (best is None or (cost, audit) < best) and any(pattern.match("".join(x)) for x in itertools.product(*choices)):
                    best = (cost, audit)
    return best


def repaired_by_hand(rows, damage=True):
    """Result rows by conv_id of (conv_id, turn, role, text), no two of a turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(key.encode()) % 20 if damage else 9
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, lines = least_edits([(r, t, f) for (_, r, t), f in zip(mine, faults)])
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def talks(seed, n=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn * rng.choice([1, 1, 2]) + conv % 3 if turn else None, role, rng.choice(["Yes.", "no", "What?", "", None, f"t{rng.randrange(99)}.", "a!\n", "Ä…"])))
    unique = {r[:2]: r for r in rows}
    return list(unique.values())


def repaired(spark, rows, damage=True, parts=None):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, pos int").repartition(3)
    if parts:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return {r[0]: tuple(r)[1:] for r in turn_repair.repair(df, damage).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed,damage", [(1, True), (2, True), (3, False)])
def test_repair_equals_brute_force(spark, seed, damage):
    rows = talks(seed) + [(None, 0, "user", "Hi."), (None, 2, "user", "Ho."), (2**60, None, "system", "x")]
    assert repaired(spark, rows, damage) == repaired_by_hand(rows, damage)


def test_repair_of_a_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    long_ = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"n{rng.randrange(300)}", "", "Why?", f"x{rng.randrange(300)}."])) for t in range(900)]
    rows = talks(5, 20) + [(c + 100, *r[1:]) for c, r in enumerate(long_[:30])] + long_
    rows = list({r[:2]: r for r in rows if r[0] != 7 or r in long_}.values())
    for damage in (True, False):
        assert repaired(spark, rows, damage, parts=9) == repaired_by_hand(rows, damage)


def test_repair_of_repeated_rows_long_texts_and_nothing(spark):
    long_ = "word " * 200_000 + "end."
    rows = [(1, 0, "user", long_), (1, 1, "assistant", long_ + "x"), (2, 0, "user", "a."), (2, 0, "user", "a."), (3, 0, "", "")]
    found = repaired(spark, rows, damage=False)
    assert found[1][:7] == (0, 0, 0, 1, 0, 1, "KK") and found[2][:7] == (0, 0, 1, 0, 1, 5, "DKI"[1] + "DI") and found[3][5:7] == (3, "D")
    assert found[1][7] == hashlib.sha256(f"user:{long_}\nassistant:{long_}x".encode()).hexdigest()
    assert repaired(spark, []) == {}
    # all rows of a conversation may be dropped
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "a.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_dynamic_program_equals_every_edit():
    rng = random.Random(6)
    for _ in range(120):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(0, 4))]
        turns = [(turn_repair.initial(r), f) for r, _, f in rows]
        cost, rank, pointers = turn_repair.forward(turns, turn_repair.NONE)
        total, state = turn_repair.ending(cost, rank)
        entry, codes = turn_repair.backward(pointers, state)
        audit, _ = turn_repair.repaired([r[:2] for r in rows], codes, entry, True) if rows else ("", [])
        assert entry == turn_repair.NONE and (total, audit) == every_edit(rows) == least_edits(rows)[:2]


def test_codes_are_ordered_and_prefix_free():
    assert list(turn_repair.CODES) == sorted(turn_repair.CODES)
    assert not any(a != b and b.startswith(a) for a in turn_repair.CODES for b in turn_repair.CODES)
