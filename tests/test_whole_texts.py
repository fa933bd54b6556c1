"""Queries over pages use whole texts: what stands late in a long page counts as much as what stands early."""

from pyspark.sql import functions as F

from gaplens.operators import pages

FILL = "Nothing of interest is said in this line about caves. "


def test_relevant_text_reads_whole_pages(spark):
    late = "Fine Notes will get an offline mode in the coming year."
    many = [f"Fine Notes brings the large improvement number {i:03d} to everyone." for i in range(150)]
    rows = [
        (1, f"<main>{FILL * 60}{late}</main>", "News"),  # the section speaks of it after 2000 characters
        (2, f"<main>{' '.join(many)}</main>", "News"),  # more than 6000 characters
        (3, f"<section></section><p>{FILL * 90}The roadmap is long and the last of its lines is here.</p>", "Fine Notes"),  # fallback, after 4000 characters and 20 sentences
    ]
    df = spark.createDataFrame(rows, "id int, html string, title string")
    found = df.select("id", pages.relevant_text(F.col("html"), F.col("title"), F.lit("https://a.example/b"), "Fine Notes").alias("text"))
    got = {r.id: r.text for r in found.collect()}
    assert got == {1: late, 2: " ".join(many), 3: "The roadmap is long and the last of its lines is here."}


def test_page_source_reads_whole_pages(spark):
    late, many = "Fine Notes will get an offline mode in the coming year.", [f"Fine Notes brings the large improvement number {i:03d} to everyone." for i in range(150)]
    rows = [("https://github.com/a", f"<title>News</title><main>{FILL * 60}{late}</main>"), ("https://github.com/b", f"<main>{' '.join(many)}</main>")]
    found = pages.page_source(spark.createDataFrame(rows, "url string, html string"), "Fine Notes")
    assert {r.source_url[-1]: r.text for r in found.collect()} == {"a": late, "b": " ".join(many)}


def test_a_hit_is_classified_by_its_whole_page(spark):
    plans = [f"The planned change number {i:03d} comes to everybody in time." for i in range(50)]
    page = FILL * 60 + " ".join(plans)
    hit = F.struct(F.lit("Notes").alias("t"), F.lit("").alias("s"), F.lit(page).alias("p"))
    whole, bounded = pages.classified(hit["t"], hit["s"], hit["p"]), pages.classified(hit["t"], hit["s"], hit["p"], *pages.HIT)
    got = spark.range(1).select(whole.alias("w"), bounded.alias("b")).first()
    assert got.w.kind == "planned" and got.w.planned == plans and got.w.current == [] == got.w.promised
    assert got.b.kind == "other" and got.b.planned == []
    long = "x" * 300
    thin = spark.range(1).select(pages.classified(F.lit("Feature"), F.lit(long), F.lit("")).alias("c")).first().c
    assert thin.current == [f"Feature: {long}"]
