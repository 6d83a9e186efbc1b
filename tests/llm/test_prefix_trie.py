"""The trie of prefixes against a plain version: nulls, ties, repeats, long and missing conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

from tickforge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    names = {}
    for c, turns in made.items():
        node = 0
        members[node].append(c)
        for t in turns:
            node = names.setdefault((node, t), len(names) + 1)
            members[node].append(c)
        ends[node].append(c)
    parent, text, depth, children = {}, {0: ""}, {0: 0}, defaultdict(list)
    for (up, t), node in names.items():
        parent[node], text[node], depth[node] = up, t[1], depth[up] + 1
        children[up].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, reverse=True):  # children are numbered after their parents
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * len(text[node].encode())
    return sorted(
        (
            (min(m), depth[n], None if n == 0 else min(members[parent[n]]), len(m), len(children[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
            for n, m in members.items()
        ), key=repr,
    )


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def fixture_rows():
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"é text {rng.randrange(3)}") for c in range(0, 90) if c % 11 for t in range(rng.randrange(1, 14))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # copies
    rows += [(300, None, None, None), (300, None, "user", ""), (300, 1, "user", "x"), (300, 1, "bot", "x"), (300, 1, "bot", "x")]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "same"), (-5, 1, "user", "same"), (402, 0, None, "only")]
    rows += [(500, t, "user", f"{t % 7}") for t in range(2600)] + [(501, t, "user", f"{t % 7}") for t in range(2590)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_plain_version(spark):
    rows = fixture_rows()
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain_trie(rows)


def test_small_stretches_and_strings_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [r for r in fixture_rows() if r[0] != 501 and r[0] != 500]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_strings_are_cut_and_digested_in_order(spark):
    import pyarrow as pa

    ids = list(range(-3, 3 * prefix_trie.CHUNK))
    batch = pa.RecordBatch.from_arrays([pa.array([4] * len(ids) + [9]), pa.array([*ids, 1])], ["node", "c"])
    strings = list(prefix_trie._strings(iter([batch])))
    assert max(x.count(",") for x in strings[0].column("ids").to_pylist()) < prefix_trie.CHUNK
    digests = {r["node"]: r["ends_sha256"] for b in prefix_trie._digests(iter(strings)) for r in b.to_pylist()}
    assert digests == {4: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 9: hashlib.sha256(b"1").hexdigest()}


def test_empty_table_and_extra_columns(spark):
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(0, 0, "user", "a"), (1, 0, "user", "a")]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], SCHEMA + ", node long, c string")
    assert got(prefix_trie.prefix_trie(docs)) == plain_trie(rows)
