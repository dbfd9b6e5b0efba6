import hashlib
from zlib import crc32

from pyspark.sql import functions as F

from sparkloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def brute(rows, family=5, shared=9):
    """Nodes by walking all prefixes; conv_ids not negative."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = crc32(str(c).encode()) % shared
        built[c] = turns.get(c - c % family, [])[:h] + turns[c][h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in members if m[:-1] == node and m]
        leaves = [m for m in below if not any(x[:-1] == m and x for x in members)]
        saved = sum((len(members[m]) - 1) * (len(m[-1][1].encode()) if m else 0) for m in below)
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, trie.prefix_trie(df).collect()), key=str)


def test_odd_rows_match_brute_force(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} {'é' * (c % 3)}") for c in range(12) for t in range(c % 7)]
    rows += [(1, None, None, None), (1, None, "user", ""), (2, 3, "user", "again"), (2, 3, "user", "again"), (None, 0, "user", "lost"), (17, 0, "user", "far\0away"), (17, 1, "user\0", "far")]
    rows += [(c, t, "user", "same") for c in (40, 41, 42, 43, 60, 61) for t in range(9)]
    assert run(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "lost")]) == []


def test_hot_prefix_and_long_conversation(spark):
    """Most conversations are one; one conversation spans many ranges, far deeper than there are rounds."""
    rows = [(5 * c, t, "user", f"hot {t}") for c in range(150) for t in range(3)]
    rows += [(1000, t, "user", f"long {t}") for t in range(400)] + [(1005, t, "user", f"long {t}" if t < 300 else "other") for t in range(310)]
    got = run(spark, rows)
    assert len(got) == 1 + 3 + 400 + 10
    root = next(r for r in got if r[1] == 0)
    assert root[3:6] == (152, 2, 3)
    hot = next(r for r in got if r[1] == 3 and r[0] == 0)
    assert hot[3:7] == (150, 0, 1, 149 * len("hot 2")) and hot[7] == hashlib.sha256(",".join(str(5 * c) for c in range(150)).encode()).hexdigest()


def test_rounds_do_not_grow_with_depth(spark, monkeypatch):
    rounds = []
    peel = trie.peel
    monkeypatch.setattr(trie, "peel", lambda chains: rounds.append((chains.count(), chains.agg(F.max("pending")).first()[0])) or peel(chains))
    run(spark, [(5, t, "user", f"{t}") for t in range(200)])
    assert rounds == [(1, 0)]


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("g"), "id")
    got = trie.running_sums(df, ["g"], [F.col("id")], {"n": F.lit(1).cast("long"), "s": F.col("id")}).collect()
    for g in (0, 1):
        rows = sorted((r["id"], r["n"], r["s"]) for r in got if r["g"] == g)
        total = 0
        for i, (x, n, s) in enumerate(rows):
            total += x
            assert (n, s) == (i + 1, total)
