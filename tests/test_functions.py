"""Golden tests for column expressions (FIXTURES.md sections 2-5)."""

from pyspark.sql import functions as F

from viewlens.functions import columns as C


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_video_id(spark):
    """P11; TR3 (illegal characters decoded, blank v absent), TR4 (&amp;v is key 'amp;v')."""
    urls = ["https://www.youtube.com/watch?v=AAA", "https://x/w?l=1&v=B%20b&v=c#f",
            "https://x/w?l=1&amp;v=X", "https://x/w?v=", "https://x/w?v=a+b", "https://x/p",
            "https://x/w#?v=z", "https://x/w?v=a b|c"]
    assert one_col(spark, urls, C.video_id) == ["AAA", "B b", None, None, "a b", None, None, "a b|c"]


def test_query_param_matches_split_rule(spark):
    """The regex form against the rule it encodes: split the query on '&',
    the first pair starting with 'v=' that has a value."""
    from urllib.parse import unquote_plus

    def rule(u):
        q = u.split("#")[0].split("?", 1)
        if len(q) < 2 or "#" in u.split("?")[0]:
            return None
        for pair in q[1].split("&"):
            if pair.startswith("v=") and len(pair) > 2:
                return unquote_plus(pair[2:])
        return None

    urls = ["https://x/w?v=&v=x", "https://x/w?xv=1&v=2", "https://x/w?&&v=q&v=r", "https://x/w?",
            "https://x/w?v", "https://x/w?v==e", "https://x/w?a=1&vv=2", "https://x/w?a=v=3",
            "https://x/w?v=%41%2B", "https://x/w?q=1&v=k#v=no", "https://x/w?v=&"]
    assert one_col(spark, urls, C.video_id) == [rule(u) for u in urls]


def test_iso_duration(spark):
    isos = ["PT1H2M3S", "PT15M", "PT45S", "PT2H5S", "PT", "", "P1DT2H", "P0D", "PT1.5S", None]
    assert one_col(spark, isos, C.iso_duration_seconds) == [3723, 900, 45, 7205, 0, 0, 0, 0, 0, 0]


def test_canonical_category_and_names(spark):
    """P16/P19; TR13: float-like ids are canonicalised once."""
    ids = ["24", "24.0", " 24 ", "23", "34", "99", "", "abc", None, "24.5"]
    canon = one_col(spark, ids, C.canonical_category)
    assert canon == ["24", "24", "24", "23", "34", "99", None, None, None, None]
    df = spark.createDataFrame([(c,) for c in canon], "c string")
    names = [r[0] for r in df.select(C.category_name("c")).collect()]
    assert names[:6] == ["Entertainment"] * 3 + ["Comedy", "Comedy", "Unknown"]
    assert names[6:] == ["Unknown"] * 4
    ev = [r[0] for r in df.select(C.category_name("c", default=None)).collect()]
    assert ev[5] == "Category 99"


def test_export_timestamp(spark):
    texts = ["Feb 6, 2026, 2:02:26 PM EST", "Feb 6, 2026, 2:02:26\u202fPM EST",
             "Jan 1, 2024, 12:00:00 AM PST", "Mar 3, 2024, 1:02:03 PM GMT+1",
             "Mar 3, 2024, 1:02:03 PM UTCXYZW"]
    body = spark.createDataFrame([(f"x<br>{t}<br>",) for t in texts], "b string")
    got = body.select(C.parse_export_timestamp(C.export_timestamp_text("b")).alias("t")).collect()
    vals = [None if r.t is None else r.t.isoformat() for r in got]
    assert vals == ["2026-02-06T14:02:26", "2026-02-06T14:02:26", "2024-01-01T00:00:00",
                    "2024-03-03T13:02:03", None]


def test_days_floor(spark):
    """TR7: whole 24-hour periods, not date boundaries."""
    df = spark.createDataFrame([("2023-01-10 09:00:00", "2023-01-12 08:00:00"),
                                ("2024-01-01 23:00:00", "2024-01-03 01:00:00")], "a string, b string")
    df = df.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert [r[0] for r in df.select(C.days_floor("a", "b")).collect()] == [1, 1]


def test_duration_and_count_text(spark):
    """P33/P34; TR16: 100+ hours keep every digit (no lpad truncation)."""
    assert one_col(spark, [3723, 123, 59, 360123, 0, -1, None], C.duration_text, "bigint") == [
        "1h02m03s", "2m03s", "0m59s", "100h02m03s", "N/A", "N/A", "N/A"]
    assert one_col(spark, ["1235.5", None, "x", "-7.9"], C.count_text) == ["1,235", "N/A", "N/A", "-7"]


def test_round_ratio_half_even(spark):
    """TR8: exact half-even on the rational value; TR10: x/0 is NULL, not an error."""
    df = spark.createDataFrame([(9, 8), (1, 8), (3, 8), (1, 3), (5, 0)], "n long, d long")
    got = [r[0] for r in df.select(C.round_ratio("n", "d", 2)).collect()]
    assert got == [1.12, 0.12, 0.38, 0.33, None]


def test_clean_title_and_unescape(spark):
    vals = ["Tom &amp; Jerry\npart 2", "  plain  ", "a &lt;b&gt; &#39;c&#39;"]
    assert one_col(spark, vals, C.clean_title) == ["Tom & Jerry part 2", "plain", "a <b> 'c'"]


def test_md5_rank_key_order_matches_hex(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    rows = df.select("k", C.md5_rank_key("k").alias("h"),
                     F.md5(F.concat("k", F.lit(":42"))).alias("m")).collect()
    by_h = [r.k for r in sorted(rows, key=lambda r: (r.h, r.k))]
    by_m = [r.k for r in sorted(rows, key=lambda r: (r.m, r.k))]
    assert by_h == by_m


def test_numeric_coercion_never_raises(spark):
    """TR10: bad casts give NULL under ANSI."""
    vals = ["12", "12.0", "1e3", "", "n/a", None, "9" * 30, " 7 "]
    assert one_col(spark, vals, C.to_double) == [12.0, 12.0, 1000.0, None, None, None, 1e30, 7.0]
    assert one_col(spark, vals, C.to_long) == [12, 12, 1000, None, None, None, None, 7]
