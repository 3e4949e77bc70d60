import random

import xxhash

from landgrid.llm.components import connected_components
from landgrid.llm.simhash import fingerprint, near_links, simhash_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_brute_force(docs):
    for r in docs.select("text").collect():
        if not r.text or len(r.text) < 5000:
            assert fingerprint(r.text) & (1 << 64) - 1 == brute_print(r.text)


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints)[:12]:
        for _ in range(6):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    for _ in range(40):  # a crowd that shares a segment
        prints.add(rng.getrandbits(64) & ~0xFFF | 0x123)
        prints.add((0xABCD1234 << 32) | 1 << rng.randrange(32) | 1 << rng.randrange(32))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    pairs = {(a, b) for a in signed for b in signed if a < b and far(a, b) <= 2}
    for crowd in (512, 3, 0):
        links = near_links(frame, crowd)
        assert {(min(r), max(r)) for r in links.collect()} == pairs
    found = {r.node: r.root for r in connected_components(near_links(frame)).collect()}
    want = groups(signed, lambda a, b: far(a, b) <= 2)
    by_found, by_want = {}, {}
    for p in signed:
        by_found.setdefault(found.get(p, p), set()).add(p)
        by_want.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, by_found.values())) == sorted(map(sorted, by_want.values()))


def test_long_path_is_one_component(spark):
    links = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert connected_components(links).select("root").distinct().count() == 1


def test_components_of_all_rows(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash_components(docs).collect())
    rows = [(r.doc_id, brute_print(r.text) if not r.text or len(r.text) < 5000 else fingerprint(r.text) & (1 << 64) - 1) for r in docs.select("doc_id", "text").collect()]
    root = groups(sorted({p for _, p in rows}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, p in rows:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    assert got == sorted((d if d is not None else -1, f"{p:016x}", least.get(root[p])) for d, p in rows)
    assert {4, 5, 6}.issuperset({c for d, f, c in got if f == "0" * 16})


def test_empty_table(empty):
    assert simhash_components(empty).count() == 0
