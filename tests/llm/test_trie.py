"""The conversation trie against a plain one."""

import hashlib
import zlib
from collections import defaultdict

from quarry.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, seq string"


def rebuilt(rows, family):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if family is None:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % family, [])[:h] + turns[h:]
    return out


def plain(rows, family=None):
    convs = rebuilt(rows, family)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, own in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[:-1] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def logged(c, turns):
    return [(c, k, "user" if k % 2 else "assistant", t, 0, "x") for k, t in enumerate(turns)]


def test_trie(spark):
    rows = []
    for c in (5, 6, 7, 800):  # copies
        rows += logged(c, ["hi", "hello 😀", "bye"])
    rows += logged(8, ["hi", "hello 😀"]) + logged(9, ["hi", "other"]) + logged(10, ["alone", *"abc"])
    rows += logged(11, [f"t{k}" for k in range(150)]) + logged(12, [f"t{k}" for k in range(150)])  # long copies
    rows += logged(13, ["t0", "t1", "t2", None]) + [(14, None, None, None, 1, "y"), (14, None, None, None, 1, "y"), (14, 3, "", "", 1, "y")]
    rows += [(None, 0, "user", "hi", 1, "y")]
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_rebuilt_query(spark):
    rows = []
    for c in [*range(100, 130), *range(200, 212), 300, 407]:
        rows += logged(c, [f"{c % 3}-{k}" for k in range(1 + c % 8)])
    rows += [t for c in range(901, 907) for t in logged(c, ["x"])]  # of an absent family
    rows += logged(500, ["only"]) + logged(511, list("abcdefg")) + logged(512, list("ab"))
    got = found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), family=100))
    assert got == plain(rows, 100)
    assert any(not t for t in rebuilt(rows, 100).values())  # a turnless one takes part


def test_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(none).count() == 0
    one = logged(3, ["a", "bc"]) + logged(4, ["a", "bc"])
    assert found(trie.conversation_trie(spark.createDataFrame(one, SCHEMA))) == plain(one)
