"""URL filter and decontamination against plain Python."""

import random
from math import comb

import pytest

from tests.llm.test_similarity import word_shingles
from wavelane.llm import decontaminate, url_graph

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[2]) if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "https://example.com/en/", "https://a.example.com/en/x", "https://example.com/en",
        "https://other.com", "https://other.com?x=/en/", "https://other.com/#a/b", "ftp://x.net/es/1", "http://x.net/de/1", "http://y.org/a\nb",
        "http://com/", "http://xcom/", "http://ÄÖ.net/fr/", "http://a://b/c", "http://net/es/", "http://x.net/es/1"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    got = url_graph.judge(pages, RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = parse(URLS[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow") or verdict is None
    assert url_graph.judge(pages.limit(0), RULES).count() == 0


def propagate(seeds, edges, rounds, damping):
    out = {}
    for (s, _), n in edges.items():
        out[s] = out.get(s, 0) + n
    ranks = {h: (1 - damping) * v for h, v in seeds.items()}
    for _ in range(rounds):
        new = {h: (1 - damping) * v for h, v in seeds.items()}
        for (s, d), n in edges.items():
            new[d] = new.get(d, 0) + damping * ranks.get(s, 0) * n / out[s]
        ranks = new
    return ranks


@pytest.fixture
def linked(spark):
    """bad.net is blocked; farm.org links to it only; shop.org is linked by trusted hosts and links to it once in ten."""
    def page(i, url, targets):
        return i, url, "".join(f'<a class=x HREF="https://{t}/p">t</a>' for t in targets) + '<a href="/own">o</a>'
    rows = [page(1, "http://bad.net/es/1", []), page(2, "http://farm.org/1", ["bad.net"] * 3), page(3, "http://good.com/1", ["Shop.org", "good.com"]),
            page(4, "http://shop.org/1", ["bad.net"] + ["good.com"] * 9), page(5, "http://far.org/", ["farm.org"]), (6, None, None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_trust_and_distrust(linked):
    rows, pages = linked
    edges = {("farm.org", "bad.net"): 3, ("good.com", "shop.org"): 1, ("shop.org", "bad.net"): 1, ("shop.org", "good.com"): 9, ("far.org", "farm.org"): 1}
    assert {(r["src"], r["dst"]): r["links"] for r in url_graph.host_edges(pages).collect()} == edges
    got = {r["page_id"]: r for r in url_graph.judge(pages, RULES).collect()}
    hosts = [parse(u)[0] for _, u, _ in rows if u]
    seeds = {h: 0.0 for h in hosts}
    trust = propagate(seeds | {"good.com": 1.0}, edges, url_graph.ROUNDS, 0.85)
    distrust = propagate(seeds | {"bad.net": 1.0}, {(d, s): n for (s, d), n in edges.items()}, url_graph.ROUNDS, 0.85)
    for i, u, _ in rows[:5]:
        assert got[i]["trust"] == pytest.approx(trust[parse(u)[0]])
        assert got[i]["distrust"] == pytest.approx(distrust[parse(u)[0]])
    assert [got[i]["verdict"] for i in range(1, 7)] == ["block", "block", "allow", "allow", "block", "allow"]


def test_url_twin(spark, linked, tmp_path):
    import duckdb

    rows, _ = linked
    pages = spark.createDataFrame(rows + [(i + 100, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.execute(url_graph.twin(RULES)).fetchall(), key=str)
    got = url_graph.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_decontamination_equals_all_pairs(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(rng.randint(5, 90))) for i in range(30)] + [(40, "two words"), (41, None), (42, ""), (43, "..."), (None, make(20)), (1, make(8))]
    docs = []
    for i in range(80):
        text = make(rng.randint(0, 300))
        if i % 2:
            passage = items[i % 30][1].split()
            for _ in range(i % 4):
                passage[rng.randrange(len(passage))] = "other"
            text += "\n" + " , ".join(passage).upper() + "\n" + make(rng.randint(0, 1500))
        docs.append((i, text))
    docs += [(200, "Two, words!"), (201, "two words more"), (204, "here are two... WORDS in a row"), (205, "words two"), (206, "one"), (202, None), (203, ""), (None, items[0][1]), (5, items[3][1])]
    size, texts = {}, {}
    cut = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    for i, t in items:
        if i is not None and word_shingles(t):
            size.setdefault(i, set()).update(word_shingles(t))
    lengths = {5} | {len(x) for q in size.values() for x in q}
    for i, t in docs:
        w = cut(t)
        if i is not None:
            texts.setdefault(i, set()).update(tuple(w[k:k + n]) for n in lengths for k in range(len(w) - n + 1))
    want = {(d, i): (len(s & q), len(q)) for d, s in texts.items() for i, q in size.items() if len(s & q) >= 0.8 * len(q) - 1e-9}
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, hash long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["n_shingles"]) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == want and len(want) > 15
    kept = decontaminate.keep_uncontaminated(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0


def test_least_hits():
    for n in (1, 7, 32, 64, 120):
        c = decontaminate.least_hits(n, 0.8, 1e-9)
        assert c >= 1
        assert c == 1 or sum(comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(c)) <= 1e-9
    found = decontaminate.size_partitions(32, 0.8, 1e-9)
    assert min(found) == 5 and found[5][0] == 32 and found[7][0] == 48  # the sketch grows with the partition
    for u in (5, 6, 7):
        n, c = found[u]
        for size in range(max(1 << u, 33), 2 << u):
            held = -(-size * 8 // 10)
            assert sum(comb(held, k) * comb(size - held, n - k) for k in range(c)) <= 1e-9 * comb(size, n)
    assert found[5][1] >= decontaminate.least_hits(32, 0.8, 1e-9)


def test_long_items_at_the_threshold_are_found(spark):
    """Items of 40 to 500 shingles, each in documents that hold 0.8 of them and a little less."""
    rng = random.Random(31)
    items, docs = [], []
    for i in range(40):
        n = rng.choice((40, 64, 65, 100, 200, 350, 500))
        words = [f"i{i}w{k}" for k in range(n + 4)]
        items.append((i, " ".join(words)))
        shared = -(-n * 8 // 10)
        docs += [(2 * i, " ".join(words[:shared + 4]) + " end"), (2 * i + 1, " ".join(words[:shared + 3]) + " end")]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == {(2 * i, i) for i in range(40)}


def test_no_python_in_the_plans(spark):
    folder = "/root/testdata/sf0.001"
    from wavelane.llm.queries import QUERIES
    for name in ("op3_url_filter", "op8_decontamination"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op3_url_filter", "op8_decontamination"])
def test_query_equals_sql(spark, name):
    import duckdb

    from wavelane.llm.queries import ORACLES, QUERIES
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got, want = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
