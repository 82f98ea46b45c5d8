"""Functions and operators that SQL does not check, against plain Python."""

import itertools
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import maps, rules, text, time
from lodestrata.operators import extraction, graph, learning, ranges, rows
from lodestrata.sources import readers


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80//a/./b/../c/?utm_source=x&b=2&a=1#top", "http://example.com/a/c/?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/x?gclid=1", "https://example.com:8443/x"),
        ("https://bücher.example/ü", "https://xn--bcher-kva.example/%C3%BC"),
        ("", ""),
        (None, ""),
    ],
)
def test_urls(url, want):
    assert text.one_url(url) == want


def test_plain_url_agrees_with_the_full_one(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = pages.select(text.plain_url(F.col("url")).alias("a"), text.normalize_url("url").alias("b")).where("a != b").count()
    assert got == 0


def test_names():
    assert text.one_name(" ＡＢＣ（Co.）, Ltd ") == "abccoltd"
    assert text.one_name(None) == ""


def test_seniority(spark):
    titles = {"Director of Sales": "director_plus", "Deputy Director": "below_director_or_ic", "销售总监": "director_plus", "副总监": "below_director_or_ic", "算法经理": "below_director_or_ic", "Software Engineer": "unknown", "Poet": "unknown"}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.seniority(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == titles


def test_signals_in_order(spark):
    cases = {"公司完成融资": "funding", "招聘工厂经理": "workforce_cluster", "招聘": "job_ad", "融资终止": "other", "并购融资": "merger_acquisition", "x": "other"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.signal(F.col("t"))["event_type"].alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_workforce_words_can_be_left_out(spark):
    row = spark.createDataFrame([("招聘工厂经理",)], "t string").select(text.signal(F.col("t"), workforce=False)["event_type"]).first()
    assert row[0] == "job_ad"


def test_older_names_of_events(spark):
    names = {"clinical_milestone": "regulatory_or_clinical", "supplier_call": "project_call", " financing ": "funding", "own_word": "own_word"}
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", text.canonical_event_type(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == names


@pytest.mark.parametrize("most", (1, 3, 4, 7, 100))
def test_byte_parts(spark, most):
    texts = ["", "a", "ééééé", "abc日本語🙂def", "🙂🙂", "x" * 50, "naïve " * 5]

    def by_hand(t):
        parts, now = [], ""
        for c in t:
            if now and len((now + c).encode()) > most:
                parts.append(now)
                now = ""
            now += c
        return [*parts, now] if now or not parts else parts

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.byte_parts(F.col("t"), most).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == {t: by_hand(t) for t in texts}


def test_rounds(spark):
    cases = {" A轮 ": "A轮", "B": "B轮", "C++轮（首期）": "C++轮", "Pre-A轮": "Pre-A", "pre ipo 轮": "pre ipo 轮", "Pre-IPO轮融资": "Pre-IPO", "preIPO": "Pre-IPO", "战略轮": "战略融资", "未知": "", "新一轮": "", "天使轮": "天使轮", "a": "a", None: ""}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rules.normal_round(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases


def test_aliases_and_triage(spark):
    row = spark.createDataFrame([("灵巧科技（中国） / Dex-Hand",)], "c string").select(rules.company_aliases(F.col("c"), F.array(F.lit("Dex Robotics"))).alias("a")).first()
    assert row["a"] == ["dex robotics", "dex-hand", "灵巧科技", "dex"] or set(row["a"]) >= {"灵巧科技", "dex-hand", "dex robotics", "dex"}
    assert "中国" not in row["a"] and "robotics" not in row["a"]
    hits = [
        ("Acme招聘总监", "", "https://www.liepin.com/job/1", "2024-02-03", 10, "high"),
        ("Acme 总监", "", "https://www.liepin.com/x", "2024-02-03", 8, "medium"),
        ("Acme论文", "总监", "https://x.org/job/1", "2024-02-03", 2, "low"),
        ("other", "", "https://x.org/", None, -4, "low"),
    ]
    rows = spark.createDataFrame([h[:4] for h in hits], "t string, s string, u string, d string")
    t = rules.triage(F.array(F.lit("acme")), F.lit("acme after:2024-01-01 before:2024-03-01"), F.col("t"), F.col("s"), F.col("u"), F.col("d"))
    assert [(r["t"]["score"], r["t"]["priority"]) for r in rows.select(t.alias("t")).collect()] == [h[4:] for h in hits]


def test_long_augmenting_paths():
    n = 3000  # row i may take columns i and i + 1; the last one asks all others to move
    edges = [(i, i + 1) for i in range(n)] + [(i, i) for i in range(1, n)] + [(n, n)]
    found = ranges.kuhn(edges, list(range(n, -1, -1)))
    assert len(found) == n and len(set(found.values())) == n and all((r, c) in set(edges) for r, c in found.items())
    chain = [(i, c) for i in range(n) for c in (i, i + 1)] + [(n, 0)]
    assert len(ranges.kuhn(chain, [*range(n), n])) == n + 1


def test_streams_of_part_files(spark, sf_dir, tmp_path):
    from lodestrata.plans import catalog

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("st1_stream_dedup", "st4_first_last_seen", "st_tumbling_window", "st_sliding_window", "st_session_window"):
        one, parts = (sorted(map(repr, catalog.QUERIES[name](spark, d).collect())) for d in (sf_dir, str(tmp_path)))
        assert one and one == parts


def test_slots(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv]) if k else F.create_map().cast("map<string,string>")
    one = lambda a, b, days: spark.range(1).select(maps.slots_compatible(a, b, F.lit(days), F.lit(45.0)).alias("x")).first()["x"]
    assert one(m(round="A"), m(round="A"), 40.0)
    assert not one(m(round="A"), m(round="B"), 1.0)
    assert one(m(x="1"), m(y="1"), 7.0)
    assert not one(m(x="1"), m(y="1"), 8.0)
    assert one(m(round="A", city="x"), m(round="A"), 44.0)


def test_lenient_dates(spark):
    cases = {"2024-02-30": None, "2024年3月5日": "2024-03-05", "on 2023/7": "2023-07-01", "1999-01-01": None, "": None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", time.lenient_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases


def test_matching_is_maximum(spark):
    edges = [("g", 1, 10), ("g", 1, 11), ("g", 2, 10), ("g", 3, 11), ("g", 3, 12), ("h", 1, 10), ("h", 2, 10)]
    got = ranges.matching(spark.createDataFrame(edges, "g string, l long, r long"), "g", "l", "r").collect()
    for g in ("g", "h"):
        own = [(l, r) for x, l, r in edges if x == g]
        found = [(r["l"], r["r"]) for r in got if r["g"] == g]
        best = max(n for n in range(len(own) + 1) for c in itertools.combinations(own, n) if len({a for a, _ in c}) == len(c) == len({b for _, b in c}))
        assert set(found) <= set(own) and len(found) == best


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


def test_events_cluster_in_order(spark):
    days = [(1, "2024-01-01"), (2, "2024-01-03"), (3, "2024-01-10"), (4, "2024-01-04")]
    claims = spark.createDataFrame(days, "id long, d string").select(F.lit("c").alias("c"), "id", F.col("d").cast("timestamp_ntz").alias("at"))
    got = {r["id"]: r["event"] for r in ranges.cluster_events(claims, ["c"], "at", "id", 3.0).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3}


def test_units_lose_nothing(spark):
    t = "One. Two!\nThree 句子。" + "x" * 25
    u = extraction.units(spark.createDataFrame([(1, t)], "k long, t string"), "k", "t", 10).orderBy("unit").collect()
    assert "".join(r["text"] for r in u) == t
    assert all(t[r["start"] : r["end"]] == r["text"] for r in u)


def test_logistic_descents_agree(spark):
    data = spark.createDataFrame([(float(i % 5), float(i % 3), int(i % 5 > 2), 1.0) for i in range(300)], "a double, b double, y int, w double")
    one = learning.fit_logistic(data, ["a", "b"], "y", "w", rounds=20)
    two = learning.fit_distributed(data, ["a", "b"], "y", "w", rounds=20)
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert one["a"] > 0


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 6)], "k long, keep string, fill string, n long")
    new = spark.createDataFrame([(2, "c", "", 4), (3, "d", "z", 9)], "k long, keep string, fill string, n long")
    got = rows.upsert(old, new, ["k"], {"keep": "keep", "fill": "fill", "n": "min"})
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", 5), (2, "b", "y", 4), (3, "d", "z", 9)]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table jobs (id integer, title text)")
        db.executemany("insert into jobs values (?, ?)", [(i, f"t{i}") for i in range(20)])
    got = readers.read_sqlite(spark, path, "jobs", "id:long,title:string,salary:string", 3)
    assert sorted(map(tuple, got.collect())) == sorted((i, f"t{i}", None) for i in range(20))


def test_feeds_and_reports(spark, tmp_path):
    assert readers.parse_feed("<feed><entry><title>a</title><link href='u'/><updated>2024</updated><summary>s</summary></entry></feed>") == [("a", "u", "2024", "s")]
    assert readers.parse_feed("<broken") == []
    (tmp_path / "v1.json").write_text('[{"company": "a"}]')
    (tmp_path / "v2.json").write_text('{"schema_version": 2, "leads": [{"company": "b"}, {"company": "c"}]}')
    got = readers.read_report(spark, str(tmp_path / "*.json"), "company:string")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b"), (2, "c")]


def test_frozen_snapshot(spark, tmp_path):
    readers.write_once(spark.range(3), str(tmp_path / "s"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readers.write_once(spark.range(3), str(tmp_path / "s"))


@pytest.mark.parametrize("t", ["", "a", "abc", "abcabcab", "日本語のテキスト", "x🙂y🙂z🙂x🙂y", "a\nb\nc"])
def test_grams(spark, t):
    got = spark.createDataFrame([(t,)], "t string").select(text.char_grams(F.col("t"), 3).alias("g")).first()["g"]
    assert got == list(dict.fromkeys(t[i : i + 3] for i in range(max(len(t) - 2, 1)))) if t else got == []
