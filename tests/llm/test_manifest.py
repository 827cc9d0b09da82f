import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gradewell.llm import manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def raise_tree(nodes):
    """(root, siblings of each leaf as (left, right) by level), by whole levels."""
    ways = [[] for _ in nodes]
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, above = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k, own in enumerate(held[a : a + 8]):
                for leaf in own:
                    ways[leaf].append((run[:k], run[k + 1 :]))
            upper.append(h(*run))
            above.append(sum(held[a : a + 8], []))
        nodes, held = upper, above
    return nodes[0], ways


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaves = [(r, h(*map(field, (r[0], r[3], r[2], r[4], r[1])))) for r in rows]
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, trees = [], []
    for lang in langs:
        own = sorted((x for x in leaves if x[0][2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *raise_tree([x[1] for x in own])))
    root, tops = raise_tree([t[1] for t in trees])
    for (own, subroot, ways), top in zip(trees, tops):
        for (r, leaf), way in zip(own, ways):
            proof = "".join("".join(a) + "".join(b) for a, b in way + top)
            folded = leaf
            if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0:
                folded = h(*map(field, (r[0], r[3], r[2], r[4], lower(r[1]))))
            for a, b in way + top:
                folded = h(*a, folded, *b)
            out.append((str(r[0]), leaf, subroot, root, h(proof), folded, folded == root))
    return sorted(out)


def listed(documents, rows, langs):
    rng = random.Random(2)
    return [(i, t, rng.choice(langs)) for i, t in rows]


def full(rows):
    return [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]


def run(spark, tables, frame):
    return sorted(tuple([str(r[0]), *r[1:]]) for r in queries.op12_manifest(spark, tables(documents=frame)).collect())


@pytest.mark.parametrize("n", [1, 9, 600])
def test_query_equals_whole_levels(spark, documents, tables, n):
    rng = random.Random(n)
    rows = [(i * 3 % 7919, f"Text {i} Of {rng.random()}", rng.choice(["en", "de", None, "É", "zz", ""])) for i in range(n)]
    assert run(spark, tables, documents(rows)) == brute(full(rows))


def test_one_group_of_several_blocks(spark, documents, tables, monkeypatch):
    """Blocks of 64 leaves: four rounds in one group, one in another."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(i, f"Text {i}", "en" if i % 9 else "de") for i in range(700)] + [(9000, "One", "x")]
    rows += [(10_000 + i, "t", f"lang {i}") for i in range(20)]
    assert run(spark, tables, documents(rows)) == brute(full(rows))


def test_more_leaves_than_a_block(spark, documents, tables):
    rows = [(i, f"Text {i}", "en") for i in range(manifest.BLOCK + 10)]
    assert run(spark, tables, documents(rows)) == brute(full(rows))


def test_odd_rows(spark, documents, tables, odd_rows):
    rows = listed(documents, odd_rows, ["en", None, "de"])
    frame = documents([r for r in rows if r[2]]).unionByName(
        documents([(i, t) for i, t, lang in rows if not lang]).withColumn("lang", F.lit(None).cast("string"))
    )
    expected = brute(full(rows))
    assert run(spark, tables, frame) == expected
    clash = frame.select("*", *[F.lit(1).alias(c) for c in ("tree", "index", "size", "digest", "leaf", "order", "carried", "block")])
    assert run(spark, tables, clash) == expected
    assert manifest.manifest(frame.limit(0)).collect() == []


def test_places_are_those_of_the_log():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 513, 4096]:
        levels = manifest.height(n)
        leaves = [bytes([i % 256, i // 256]) + bytes(30) for i in range(n)]
        log = manifest.append_log(leaves, levels)
        nodes, seen = leaves, set()
        for level in range(levels + 1):
            for j, digest in enumerate(nodes):
                at = manifest.node_place(level, j, n)
                assert log[32 * at : 32 * at + 32] == digest
                seen.add(at)
            nodes = [manifest.node(nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
        assert seen == set(range(len(log) // 32))


def test_any_changed_field_or_sibling_shows(spark, documents):
    found = manifest.manifest(documents([(i, f"Text {i}", "en") for i in range(20)])).collect()
    for r in found:
        way = manifest.steps(r["index"], r["size"]) + manifest.steps(r.group_index, r.groups)
        assert manifest.fold(bytes.fromhex(r.leaf), bytes(r.proof), way).hex() == r.root
        assert manifest.fold(bytes(32), bytes(r.proof), way).hex() != r.root
        changed = bytes([r.proof[0] ^ 1]) + bytes(r.proof[1:])
        assert manifest.fold(bytes.fromhex(r.leaf), changed, way).hex() != r.root
