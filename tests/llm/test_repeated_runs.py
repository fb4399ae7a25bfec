"""A run of letters that a URL repeats counts each time, in training and in the score."""

import math

from quillspark.llm import url_filter


def test_repeated_runs_count(spark):
    rows = [(1, "http://casino.com/win/win/win", ""), (2, "http://farm.com/blog", ""), (3, "http://farm.com/win", ""), (4, "http://shop.com/win/win", "")]
    by = {r["page_id"]: r for r in url_filter.score_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[1]["words"] == ["casino", "win", "win", "win"] and by[4]["words"] == ["shop", "win", "win"]
    # 4 words of bad pages, 7 of good ones, 5 different; win occurs three times in each
    odds = lambda bad, good: math.log((bad + 1) / (4 + 5 + 1)) - math.log((good + 1) / (7 + 5 + 1))
    want = math.log((1 + 1) / (3 + 1)) + odds(0, 1) + 2 * odds(3, 3)
    assert abs(by[4]["log_odds"] - want) < 1e-6
