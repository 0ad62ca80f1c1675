"""Line dedup, near duplicates, URL filter, fixity, packing, mixing, search and the pipeline."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.llm import ann, fixity, linededup, mixing, neardup, packing, registry, urls

from ..compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


def docs(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, n int, key string")


# --- line dedup


def test_line_dedup_empty_and_stage(spark, tables):
    assert linededup.deduped(docs(spark, [])).count() == 0
    d = tables("documents")
    assert linededup.stage(spark, d, "").columns == d.columns


def maximal_brute(rows, min_lines, min_words):
    """Every suffix with its longest common prefix with any earlier place."""
    order = sorted({(i is None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows if t is not None})
    places = [(d, p) for d, (*_, t) in enumerate(order) for p in range(len(t.split("\n")))]
    lines, out = [t.split("\n") for *_, t in order], {}
    gone, found = [set() for _ in order], []
    for n, (d, p) in enumerate(places):
        if not lines[d][p].split():
            continue
        longest = 0
        for e, q in places[:n]:
            k = 0
            while p + k < len(lines[d]) and q + k < len(lines[e]) and lines[d][p + k] == lines[e][q + k]:
                k += 1
            longest = max(longest, k)
        if longest >= min_lines or sum(len(x.split()) for x in lines[d][p : p + longest]) >= min_words:
            gone[d] |= set(range(p, p + longest))
            found.append((None if order[d][0] else order[d][1], order[d][2], p, longest))
    for d, (none, i, _, t) in enumerate(order):
        out[None if none else i, t] = "\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d])
    return out, sorted(found, key=repr)


@pytest.mark.parametrize(("seed", "min_lines"), [(0, 4), (1, 3), (2, 1), (3, 5), (4, 2)])
def test_maximal_runs_brute_force(spark, seed, min_lines):
    r = random.Random(seed)
    pool = ["a", "b c", "", "", "d " * 6, "e"]
    rows = [(r.choice([None, *range(30)]), None if r.random() < 0.05 else "\n".join(r.choice(pool) for _ in range(r.randint(0, 40 if seed == 4 else 12)))) for _ in range(40)]
    rows += rows[:3] + [(90 + k, "\n".join(["a", "e", "b c", "f"][(i * i // 3 + i // 7) % 4] for i in range(k, 70))) for k in (0, 0, 5)]
    want, found = maximal_brute(rows, min_lines, 6)
    d = docs(spark, [(i, t, None) for i, t in rows])
    assert sorted(((x["doc_id"], x["digest"].hex(), x["pos"], x["size"]) for x in linededup.longest(d, min_lines, 6).collect()), key=repr) == found
    got = linededup.deduped(d, min_lines, 6)
    assert {"size", "n", "key", "lines_deleted"} <= set(got.columns)
    got = got.collect()
    assert sorted(repr(g["text"]) for g in got) == sorted(map(repr, (t if t is None else want[i, t] for i, t in rows)))


def test_ranks_are_a_suffix_array(spark):
    """Ranks of each level order the prefixes as their lines' digests do, and the last level has the longest repeated run."""
    r = random.Random(3)
    texts = ["\n".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(12)] + ["\n".join("xyz" * 11)] * 2
    rows = list(enumerate(texts))
    keys = {(i, p): [hashlib.md5(x.encode()).digest() for x in t.split("\n")[p:]] for i, t in rows for p in range(len(t.split("\n")))}
    levels = linededup.suffix_ranks(docs(spark, [(i, t, None) for i, t in rows]))
    for k, level in enumerate(levels):
        got = {(x["doc_id"], x["pos"]): x["rank"] for x in level.collect()}
        prefix = {p: tuple(v[: 1 << k]) for p, v in keys.items() if len(v) >= 1 << k}
        times = {}
        for v in prefix.values():
            times[v] = times.get(v, 0) + 1
        assert set(got) == {p for p, v in prefix.items() if times[v] > 1}
        # ranks of a level are those of its pairs, so of prefixes in the order of the ranks below
        by_rank = sorted(got, key=got.get)
        assert len({got[p] for p in got}) == len({prefix[p] for p in got})
        assert [prefix[p] for p in by_rank] == sorted(prefix[p] for p in got)
    assert len(levels) == 6


def test_stage_deletes_the_tail_of_a_run(spark):
    run = "\n".join(" ".join(f"w{n}_{k}" for k in range(n)) for n in (60, 30, 10, 8)) + "\n\n" + " ".join(f"v{k}" for k in range(9))
    got = linededup.stage(spark, docs(spark, [(1, f"one\n{run}\ntwo", None), (2, f"three\n{run}\nfour", None)]), "").collect()
    assert {g["doc_id"]: g["text"] for g in got} == {1: f"one\n{run}\ntwo", 2: "three\nfour"}


# --- near duplicates


def union(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def labelled(text):
    w = text.split()
    n, seen, out = min(5, len(w)), {}, []
    for i in range(len(w) - n + 1 if w else 0):
        s = tuple(w[i : i + n])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def family(seed, groups=6, copies=5, edits=(0, 1, 3, 12)):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(120)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice(edits)):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_near_duplicates_brute_force(spark):
    rows = family(1) + [(900, "one two"), (901, "one  two"), (902, "one three"), (903, ""), (904, ""), (905, " "), (906, None), (907, None)]
    texts = dict(rows)
    words = {i: labelled(t) for i, t in rows if t}
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if words[a] and words[b] and (m := lcs(words[a], words[b])) / (len(words[a]) + len(words[b]) - m) >= 0.8]
    pairs += [(a, b) for a, b in itertools.combinations(texts, 2) if texts[a] is not None and texts[a] == texts[b]]
    want = union(pairs, texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == want


def test_near_duplicates_of_a_large_group(spark):
    """More texts around one text than a bucket compares with each other; some are close to each other only."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(3):
            w[r.randrange(200)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    far = list(base)
    for p in range(0, 200, 25):
        far[p] = f"y{p}"
    for i in range(200, 204):
        w = list(far)
        w[3 + i - 200] = f"z{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert {got[i] for i in range(120)} == {0} and len({got[i] for i in range(200, 204)}) == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_large_buckets_lose_no_link(spark, seed):
    """Texts just short of 0.8 to the centre of a large group, each linked to one member near the centre."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    changed = lambda w, places, tag: [f"{tag}{p}" if p in places else x for p, x in enumerate(w)]
    for i in range(1, 60):
        near = changed(base, {299}, f"n{i}_")
        rows.append((i, " ".join(near)))
        if i % 6 == 0:
            # 66 of 592 shingles apart from the centre and 64 from the member; 65.8 is the most that 0.8 allows
            rows.append((100 + i, " ".join(changed(near, {1, *(20 + 40 * k + r.randrange(20) for k in range(6))}, f"f{i}_"))))
    words = {i: labelled(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if (m := len(set(words[a]) & set(words[b]))) / (len(words[a]) + len(words[b]) - m) >= 0.8]
    pairs = [(a, b) for a, b in pairs if (m := lcs(words[a], words[b])) / (len(words[a]) + len(words[b]) - m) >= 0.8]
    # every pair with a common key
    sketch = {i: set(neardup.keys(neardup.shingles(t), 24, neardup.K).tolist()) for i, t in rows}
    want = union([(a, b) for a, b in pairs if sketch[a] & sketch[b]], words)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None) for i, t in rows]), small=4).collect()}
    assert got == want and set(want.values()) == {0}
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None) for i, t in rows])).collect()} == want


def test_components_of_long_chains(spark):
    """Chains whose nodes are numbered in random order, a band and a star."""
    r = random.Random(2)
    ids = r.sample(range(10**6), 1400)
    chain, band, star = ids[:500], ids[500:1300], ids[1300:]
    pairs = [*zip(chain, chain[1:], strict=False), *((band[i], band[i + k]) for k in range(1, 5) for i in range(800 - k)), *((star[0], x) for x in star)]
    pairs += [(b, a) for a, b in pairs[::7]]
    got = {x["node"]: x["label"] for x in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union(pairs, ids)
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame(pairs, "a long, b long"), rounds=2)
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_bounds_the_difference():
    r = np.random.default_rng(0)
    for n in (3, 80, 900, 5000):
        a = r.integers(0, 1 << 32, n, dtype=np.uint32)
        b = np.concatenate([a[: n - n // 5], r.integers(0, 1 << 32, n // 7, dtype=np.uint32)])
        p, q = neardup.parity(a)[None], neardup.parity(b)[None]
        w = min(p.shape[1], q.shape[1])
        bits = int(np.bitwise_count(neardup.folded(p, w) ^ neardup.folded(q, w)).sum())
        assert p.shape[1] == max(16, 1 << (2 * n - 1).bit_length() - 6 if n > 32 else 0) and 0.7 * len(np.setxor1d(a, b)) <= bits <= len(np.setxor1d(a, b))


def test_short_similar_texts_always_share_a_key():
    for n in range(4, 25):
        for i in range(3000 if n == 5 else 100):
            w = [f"w{n}_{i}_{k}" for k in range(n + 4)]
            a = neardup.shingles(" ".join(w))
            # one text inside the other, at exactly 0.8 where that is possible
            b = neardup.shingles(" ".join(w[: len(w) - int(0.2 * n + 1e-9)]))
            assert neardup.aligned(a, b, 0.8) > 0 and set(neardup.sketch_of(a, 24, 0.8)) & set(neardup.sketch_of(b, 24, 0.8))


def test_near_duplicate_rows_and_stage(spark):
    rows = [(5, "same text of six words here", "a"), (5, "same text of six words here", "a"), (None, "same text of six words here", "b"), (None, None, "c"), (None, None, "c"), (1, "another text entirely, of some words", "d"), (None, "lonely words without any id at all", "e")]
    d = docs(spark, rows)
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in neardup.classes(d).collect())
    assert got == [(-1, -1)] * 3 + [(-1, 5), (1, 1), (5, 5), (5, 5)]
    kept = neardup.stage(spark, d, "")
    assert kept.columns == d.columns
    assert sorted((r["source"] for r in kept.collect())) == ["a", "c", "c", "d", "e"]
    assert neardup.classes(docs(spark, [])).count() == 0


def test_sketch_depends_on_order():
    a = neardup.shingles(" ".join(f"w{i}" for i in range(200)))
    b = np.concatenate([a[100:], a[:100]])
    same = lambda x, y: (neardup.keys(x, 200, 3) == neardup.keys(y, 200, 3)).mean()
    assert same(a, a) == 1 and same(a, b) < 0.6
    assert neardup.aligned(a, b, 0.8) == 0 and neardup.aligned(a, a, 0.8) == 1
    assert len(set(neardup.shingles("a b c d e " * 9).tolist())) == 41


# --- URL filter


def test_url_parts_and_rules(spark):
    rows = ["HTTP://Foo.ORG/es/x?y#z", "no scheme", None, "a://b.example.org/es/1", "a://b.example.org/en/12", "a://xexample.org/es/", "a://q.com/fr/a://r.com/de/", "a://q.com", "a://Ä.com?x/fr/", "://org/", "a://q.net/fr/"]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    parts = [(got[i]["host"], got[i]["path"]) for i in range(len(rows))]
    assert parts == [("foo.org", "/es/x"), ("", ""), ("", ""), ("b.example.org", "/es/1"), ("b.example.org", "/en/12"), ("xexample.org", "/es/"), ("q.com", "/fr/a:"), ("q.com", ""), ("Ä.com", ""), ("org", "/"), ("q.net", "/fr/")][:6] + [("q.com", "/fr/a://r.com/de/")] + [("q.com", ""), ("Ä.com", ""), ("org", "/"), ("q.net", "/fr/")]
    assert [got[i]["rule"] for i in range(len(rows))] == ["org/", None, None, "example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None, "org/", None]
    assert got[3]["verdict"] == got[4]["verdict"] == "block" and got[0]["verdict"] == got[1]["verdict"] == got[2]["verdict"] == "allow"


def test_trust_and_distrust_flow(spark):
    link = lambda *to: "".join(f'<p><A class="x" href="{t}">t</a>' for t in to)
    pages = spark.createDataFrame(
        [
            (1, "http://good.org/", link("http://near.net/a", "//near.net", "/own")), (2, "http://bad.com/de/1", link()), (3, "http://spam.net/", link("http://bad.com/")), (3, "http://spam.net/", link("http://bad.com/")),
            (4, "http://near.net/", None), (5, "http://far.net/", link("http://far.net/2")), (6, "http://friend.net/", link("HTTPS://SPAM.net/")), (7, "http://www.spam.net/", ""),
        ],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    assert [got[i]["verdict"] for i in range(1, 8)] == ["allow", "block", "block", "allow", "allow", "block", "block"]
    assert got[4]["trust"] > 0 and got[5]["trust"] == got[5]["distrust"] == 0
    assert {r["page_id"] for r in urls.kept_pages(pages).collect()} == {1, 4, 5}
    # against power iteration on a matrix
    hosts = ["good.org", "bad.com", "spam.net", "near.net", "far.net", "friend.net", "www.spam.net"]
    m = np.zeros((7, 7))
    for a, b, w in ((0, 3, 2), (2, 1, 2), (5, 2, 1), (2, 6, 1), (6, 2, 1)):
        m[a, b] += w
    for walk, seed in ((m, 0), (m.T, 1)):
        p = walk / np.maximum(walk.sum(1), 1)[:, None]
        v = s = np.eye(7)[seed] * 0.15
        for _ in range(200):
            v = s + 0.85 * (v @ p)
        by = {r["host"]: r for r in got.values()}
        assert np.allclose([by[h]["distrust" if seed else "trust"] for h in hosts], v)


def test_url_parts_end_at_the_first_mark(spark):
    """Later ``://``, also after ``?`` or ``#`` and without a slash before them, are no part of host or path."""
    rows = {"http://a.com?u=http://b.com/de/x": ("a.com", ""), "http://a.com#http://b.fr/x": ("a.com", ""), "http://a.com/x#y?z/": ("a.com", "/x"), "http://a.com/q?to=http://b.com/de/": ("a.com", "/q"), "x?http://b.com/de/x": ("b.com", "/de/x"), "://": ("", ""), "a:///p/q": ("", "/p/q"), "h://B.Com\n/de/": ("b.com\n", "/de/"), "HTTP://A.org//x": ("a.org", "//x")}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], "page_id long, url string, html string")
    got = {r["url"]: r for r in urls.judged(pages).collect()}
    assert {u: (r["host"], r["path"]) for u, r in got.items()} == rows
    assert got["http://a.com?u=http://b.com/de/x"]["rule"] is None and got["http://a.com?u=http://b.com/de/x"]["verdict"] == "allow"
    assert got["x?http://b.com/de/x"]["rule"] == "com/de/"


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_pages_have_a_graph(spark, scale):
    """Ancestor domains join the hosts, and the masses are those of a power iteration over all pages."""
    pages = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet").withColumn("host", urls.host_of(F.col("url")))
    edges = urls.host_edges(pages, pages.select("host").distinct()).toPandas()
    hosts = {r["host"] for r in pages.select("host").distinct().collect()}
    want = {(".".join(h.split(".")[i:]), ".".join(h.split(".")[i + 1 :])) for h in hosts for i in range(h.count(".") - 1 + 0)}
    assert len(edges) > 0 and set(zip(edges["src"], edges["dst"], strict=True)) == want | {(b, a) for a, b in want}
    if scale != "sf0.01":
        return
    rows = urls.judged(pages.select("page_id", "url", "html")).toPandas()
    nodes = sorted(set(edges["src"]) | set(rows["host"]))
    place = {h: i for i, h in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    m[edges["src"].map(place), edges["dst"].map(place)] = edges["weight"]
    mass = []
    for walk, verdict in ((m, "allow"), (m.T, "block")):
        p = walk / np.maximum(walk.sum(1), 1)[:, None]
        seeds = np.bincount(rows.loc[rows["rule"].notna() & (rows["verdict"] == verdict), "host"].map(place), minlength=len(nodes)) * 0.15
        v = seeds.copy()
        for _ in range(300):
            v = seeds + 0.85 * (v @ p)
        mass.append(v[rows["host"].map(place)])
    assert np.allclose(rows["trust"], mass[0], atol=1e-5) and np.allclose(rows["distrust"], mass[1], atol=1e-5)
    free = rows["rule"].isna()
    bad = mass[1] / np.maximum(mass[0] + mass[1], 1e-300) > 0.6
    assert (free & bad).any() and ((rows["verdict"] == "block") == bad)[free].all()


def test_url_filter_on_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judged(none).count() == 0


# --- fixity


def records(spark, rows):
    return spark.createDataFrame([(a, o, bytes(p) if p is not None else None, "x") for a, o, p in rows], "archive long, offset long, payload binary, node string")


def test_audit_locates_every_difference(spark):
    r = random.Random(0)
    rows = [(a, o * 40, r.randbytes(40)) for a in range(5) for o in range(60)]
    other = list(rows)
    changed, lost = sorted(r.sample(range(300), 4)), 123
    for i in changed:
        other[i] = (*rows[i][:2], b"y" + rows[i][2][1:])
    other.pop(lost)
    other.append((9, 17, b"new"))
    got = sorted((g["archive"], g["offset"], g["status"]) for g in fixity.audit(records(spark, rows), records(spark, other), span=100, fanout=3).collect())
    want = [(*rows[i][:2], "changed") for i in changed if i != lost] + [(*rows[lost][:2], "missing"), (9, 17, "extra")]
    assert got == sorted(want)


def test_equal_and_empty_replicas(spark):
    rows = [(0, 0, b"a"), (0, 1, None), (None, None, b"z"), (0, 0, b"b"), (0, 0, b"b")]
    assert fixity.audit(records(spark, rows), records(spark, rows[::-1])).count() == 0
    assert fixity.audit(records(spark, []), records(spark, [])).count() == 0
    assert [g["status"] for g in fixity.audit(records(spark, rows), records(spark, [])).collect()] == ["missing", "missing"]


def test_warc_round_trip(spark, tables, tmp_path):
    d = tables("pages").unionByName(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"))
    made = fixity.warc_records(d, 20).orderBy("archive", "offset").collect()
    paths = {}
    for a in {m["archive"] for m in made}:
        paths[a] = f"{tmp_path}/{a}.warc"
        with open(paths[a], "wb") as f:
            for m in made:
                if m["archive"] == a:
                    assert f.tell() == m["offset"]
                    f.write(m["payload"])
    again = fixity.read_warc(spark, paths)
    assert again.count() == d.count()
    assert fixity.audit(fixity.warc_records(d, 20), again).count() == 0


def test_warc_files_in_gzip_and_in_pieces(monkeypatch):
    import gzip

    parts = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + random.Random(n).randbytes(n) + b"\r\n\r\n" for n in (0, 5, 3000, 1, 70_000)]
    starts = [sum(map(len, parts[:i])) for i in range(5)]
    plain = fixity._unpacked
    for piece in (7, 1000, 1 << 20):
        monkeypatch.setattr(fixity, "_unpacked", lambda raw, piece=piece: plain(raw, piece))
        for raw in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
            assert list(fixity.records_of(raw)) == list(zip(starts, parts, strict=True))
        assert [x for _, x in fixity.records_of(b"".join(parts)[:-10])] == [*parts[:-1], parts[-1][:-10]]
        assert list(fixity.records_of(b"")) == [] and list(fixity.records_of(b"junk")) == [(0, b"junk")]


def test_hashed_replicas_are_those_of_the_payloads(spark, tables):
    d = tables("pages").unionByName(spark.createDataFrame([(None, None, None), (None, "u", "x"), (3, "b", "b"), (3, "a", "a"), (3, "a", "a")], "page_id long, url string, html string"))
    a, b = fixity.replicas(d, fixity.hurt, F.col("page_id") % 389 == 14, 20)
    records = fixity.warc_records(d, 20)
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(a) == key(records.select("archive", "offset", F.length("payload"), F.sha2("payload", 256)))
    assert key(b) == key(records.where("page_id % 389 <> 14").select("archive", "offset", F.length("payload"), F.sha2(fixity.hurt(F.col("page_id"), F.col("payload")), 256)))


# --- packing


def test_boundaries_are_optimal():
    for s in range(60):
        r = random.Random(s)
        n = r.randint(1, 8)
        x, c, k = sorted(r.sample(range(40), n)), [r.randint(1, 9) for _ in range(n)], r.randint(1, 4)
        b = packing.boundaries(x, c, k)
        all_ = np.repeat(x, c)
        best = min(packing.least_padding(all_, sorted({*some, x[-1]})) for some in itertools.combinations(x, min(k, n) - 1))
        assert packing.least_padding(all_, b) == best and len(b) <= k
    assert packing.boundaries([], [], 3) == []


def test_packing(spark, tables):
    d = tables("documents").select("doc_id", "text").unionByName(spark.createDataFrame([(1, None), (1, None), (None, ""), (7, "w " * 9000)], "doc_id long, text string")).withColumn("bucket", F.lit("clash"))
    got = packing.packed(d, buckets=5, budget=4096).toPandas()
    assert len(got) == d.count() and (got["padding"] == got["bucket_len"] - got["n_tokens"]).all() and (got["padding"] >= 0).all()
    lengths = got["n_tokens"].to_numpy()
    assert got["padding"].sum() == packing.least_padding(lengths, sorted(set(got["bucket_len"])))
    for (_, top), g in got.groupby(["bucket", "bucket_len"]):
        size = max(1, 4096 // max(1, top))
        n = g.groupby("batch").size()
        assert list(n.index) == list(range(len(n))) and (n.iloc[:-1] == size).all() and n.iloc[-1] <= size
    again = packing.packed(d, buckets=5, budget=4096).toPandas()
    key = lambda t: sorted(map(repr, t[["doc_id", "n_tokens", "bucket", "batch"]].values.tolist()))
    assert key(got) == key(again)
    assert packing.packed(d.where("false")).count() == 0
    by_chars = packing.packed(d, F.length("text"), 3, 10**6)
    assert by_chars.agg(F.max("n_tokens")).first()[0] == d.agg(F.max(F.length("text"))).first()[0]


# --- mixing


def water_brute(sizes, weights, budget, cap):
    target, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        w = sum(weights[s] for s in sizes if s not in full)
        left = budget - sum(cap * sizes[s] for s in full)
        over = {s for s in sizes if s not in full and w and left * weights[s] / w > cap * sizes[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        target[s] = cap * sizes[s] if s in full else (left * weights[s] / w if w else 0.0)
    return target


def test_water_filling(spark):
    r = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i}": r.choice([0, 1, 5, 50, 1000]) for i in range(9)}
        weights = {s: float(r.randint(1, 5)) for s in sizes}
        t = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
        budget = float(sum(sizes.values()))
        got = {x["source"]: x["target"] for x in mixing.water_fill(t, budget).collect()}
        want = water_brute(sizes, weights, budget, 3.0)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mixing(spark, tables):
    d = tables("documents").select("doc_id", "text", "source", "n_chars").unionByName(spark.createDataFrame([(1, "some words here", None, 3), (2, None, "src0", 0), (2, None, "src0", 0), (None, "x y", "zz", 1), (8, "", "empty", 0)], "doc_id long, text string, source string, n_chars long")).withColumn("target", F.lit("clash"))
    got = mixing.mixed(d).toPandas()
    assert len(got) == d.count() and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    sources = sorted({s for s in got["source"] if isinstance(s, str)}, key=lambda s: [ord(c) for c in s]) + [None]
    own = {s: got[got["source"].isna() if s is None else got["source"] == s] for s in sources}
    sizes = {s: int(own[s]["size"].sum()) for s in sources}
    want = water_brute(sizes, {s: float(i % 3 + 1) for i, s in enumerate(sources)}, sum(sizes.values()), 3.0)
    for s in sources:
        assert abs(own[s]["target"].iloc[0] - want[s]) < 1e-6 and abs(own[s]["taken"].sum() - want[s]) <= 1
    again = mixing.mixed(d).toPandas()
    key = lambda t: sorted(map(repr, t[["doc_id", "size", "taken"]].values.tolist()))
    assert key(got) == key(again)
    texts = mixing.repeated(d)
    assert texts.columns == d.columns
    # whole texts only, each source within half a document of its target
    made, own_texts = texts.toPandas(), {r["text"] for r in d.collect()}
    assert set(made["text"]) <= own_texts
    for s in sources:
        words = sum(len(t.split()) for t in made.loc[made["source"].isna() if s is None else made["source"] == s, "text"])
        assert abs(words - want[s]) <= own[s]["size"].max() / 2 + 1
    assert mixing.mixed(d.where("false")).count() == 0


def test_equal_rows_share(spark):
    d = docs(spark, [(1, "a b c d", "s")] * 4 + [(2, "e f g", "t"), (3, "h", "u")])
    got = mixing.mixed(d).toPandas()
    assert (got["taken"] <= 3 * got["size"].clip(lower=0)).all() and got.groupby("doc_id")["taken"].nunique().max() == 1


# --- search


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_search_recall_and_exact_scores(spark, scale):
    folder = f"/root/testdata/{scale}"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = ann.result(spark, folder).toPandas()
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        g = got[got["query_id"] == ids[i]].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[np.searchsorted(ids, g["vec_id"])], atol=1e-12)
        assert list(zip(-g["score"], g["vec_id"], strict=True)) == sorted(zip(-g["score"], g["vec_id"], strict=True))
        hits += len(set(g["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hits >= 0.9 * len(got)


def test_search_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [float("inf"), 0.0]), (None, [1.0, 1.0]), (105, [1.0]), (106, [0.5, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("codes", F.lit(1))
    got = ann.search(d, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [g["vec_id"] for g in got if g["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [g["vec_id"] for g in got if g["query_id"] == 40] == [0, 1, 2, 3, 4]
    assert {g["query_id"] for g in got} == {0, 20, 40}
    some = ann.search(d.where("vec_id in (0, 106)"), F.col("vec_id") % 20 == 0)
    assert [tuple(g) for g in some.collect()] == [(0, 1, 106, 0.5)]
    assert ann.search(d.where("false"), F.lit(True)).count() == 0 and ann.search(d, F.lit(False)).count() == 0


def test_search_leaves_out_own_ids_however_often_repeated(spark):
    """One partition with 31 rows of query 0, some of another vector, and other ids equal to it."""
    rows = [(0, [1.0, 0.5])] * 31 + [(0, [0.9, 0.9])] * 25 + [(7, [1.0, 0.5])] * 3 + [(9, [0.1, 0.2]), (20, [1.0, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = ann.search(d, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [g["vec_id"] for g in got if g["query_id"] == 0] == [7, 7, 7, 20, 9]
    assert [(g["vec_id"], round(g["score"], 9)) for g in got if g["query_id"] == 20] == [(0, 1.35)] * 5


def test_search_by_distance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.2, 3, size=(400, 1))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(d, F.col("vec_id") % 20 == 0, k=10, metric="euclidean", depth=60).toPandas()
    hits = 0
    for i in range(0, 400, 20):
        dist = ((x - x[i]) ** 2).sum(1)
        dist[i] = np.inf
        g = got[got["query_id"] == i].sort_values("rank")
        assert np.allclose(g["score"], -dist[g["vec_id"]])
        hits += len(set(g["vec_id"]) & set(np.argsort(dist)[:10]))
    assert hits >= 0.9 * 200
    with pytest.raises(ValueError):
        ann.search(d, F.lit(True), metric="cosine")


def test_search_in_blocks_of_queries(spark, tables):
    e = tables("embeddings").select("vec_id", "embedding").limit(300)
    one = ann.search(e, F.col("vec_id") % 20 == 0, k=3, books=4, words=16, depth=300)
    many = ann.search(e, F.col("vec_id") % 20 == 0, k=3, books=4, words=16, depth=300, query_block=5)
    key = lambda t: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in t.collect())
    assert key(one) == key(many)


def test_encoding_halves_the_error_and_beams_help():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    books = ann.learn(x, 6, 32)
    err = lambda beam: ((x - books.decode(ann.encode(x, books, beam)[0])) ** 2).sum()
    assert err(4) <= err(1) < 0.35 * (x**2).sum()
    codes, norms = ann.encode(x, books, 2)
    y = books.decode(codes)
    assert np.allclose(norms, (y * y).sum(1), rtol=1e-4)
    luts = (books.flat @ x[:5].T).reshape(6, 32, 5)
    assert np.allclose(ann.approximate(luts, codes), y @ x[:5].T, atol=1e-3)


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.run(spark, SF).toPandas()
    assert {"doc_id", "text", "lang", "source", "n_chars", "bucket", "batch"} <= set(out.columns) and len(P.STAGES) == 5
    assert set(out["doc_id"]) <= {r["doc_id"] for r in d.select("doc_id").collect()}
    empty = d.where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_pipeline_brute_force(spark):
    """Each stage against a plain version of it, on what the stage before kept."""
    import corpus_pipeline as P
    from skein.llm import langid

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 70 and n_chars < 2500").collect()
    rows = [tuple(r) for r in small]
    long = [r for r in rows if len(r[1].split()) > 80][:6]
    rows += [(1000 + i, t + " and so on", lang, src, 0) for i, (_, t, lang, src, _) in enumerate(long)]
    run = "\n".join(f"this is line {i} of a passage that is in two documents" for i in range(6))
    rows += [(2000, f"the first one\n{run}\nends here", "en", "src1", 0), (2001, f"quite another one\n{run}\nof this and that", "en", "src2", 0), (2002, "12 34 !!", "en", "src1", 8), (2003, None, "en", None, 0)]
    d = spark.createDataFrame(rows, schema)

    def stage(i, now):
        return [tuple(r) for r in P.STAGES[i][1](spark, spark.createDataFrame(now, schema), SF).select("doc_id", "text", "lang", "source", "n_chars").collect()]

    got = [tuple(r) for r in P.STAGES[0][1](spark, d, SF).collect()]
    model = langid.learn(d, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    names, scores = model.predict([r[1] or "" for r in rows])
    assert sorted(got) == sorted(r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= 0.3)
    assert not {2002, 2003} & {r[0] for r in got}

    lined = stage(1, got)
    want, _ = maximal_brute([(r[0], r[1]) for r in got], 4, 50)
    assert sorted((r[0], r[1]) for r in lined) == sorted((r[0], want[r[0], r[1]]) for r in got)
    assert {r[0]: r[1] for r in lined}[2001] == "quite another one\nof this and that" and all(r[4] == len(r[1]) for r in lined if r[0] == 2001)

    near = stage(2, lined)
    words = {r[0]: labelled(r[1]) for r in lined}
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if words[a] and words[b] and min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b])) and set(words[a]) & set(words[b]) and (m := lcs(words[a], words[b])) / (len(words[a]) + len(words[b]) - m) >= 0.8]
    text = {r[0]: r[1] for r in lined}
    first = {}
    for i in sorted(text):
        pairs += [(first.setdefault(text[i], i), i)]
    top = union(pairs, text)
    assert sorted(r[0] for r in near) == sorted(i for i in text if top[i] == i) and set(near) <= set(lined) and len(near) < len(lined)

    mix = stage(3, near)
    size = {r[0]: len(r[1].split()) for r in near}
    sizes = {}
    for r in near:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_brute(sizes, {s: float(i % 3 + 1) for i, s in enumerate(order)}, sum(sizes.values()), 3.0)
    assert set(mix) <= set(near) and max(mix.count(r) for r in set(mix)) <= 3
    for s in order:
        most = max(size[r[0]] for r in near if r[3] == s)
        assert abs(sum(size[r[0]] for r in mix if r[3] == s) - target[s]) <= most / 2 + 1
        # whole repetitions of all but the documents of the last round
        times = [mix.count(r) for r in near if r[3] == s and size[r[0]]]
        assert max(times, default=0) - min(times, default=0) <= 1

    packed = P.STAGES[4][1](spark, spark.createDataFrame(mix, schema), SF).toPandas()
    lengths = packed["text"].map(lambda t: len(t.split())).to_numpy()
    tops = sorted(set(packed["bucket_len"]))
    assert len(packed) == len(mix) and len(tops) <= 16 and (packed["n_tokens"] == lengths).all()
    assert packed["padding"].sum() == packing.least_padding(lengths, packing.boundaries(sorted(set(lengths.tolist())), [int((lengths == n).sum()) for n in sorted(set(lengths.tolist()))], 16))
    for (_, last), g in packed.groupby(["bucket", "bucket_len"]):
        assert g.groupby("batch").size().max() <= max(1, 65_536 // max(1, last))
