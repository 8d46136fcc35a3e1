"""OpenGraph binding against a plain reading of the tags, and in long pages."""

import random
import time

from pyspark.sql import functions as F

from mediacat.functions.conditions import running_count
from mediacat.operators import pages


def bound(tags):
    """Roots with secure URL and type, one tag after another."""
    out = []
    for kind in ("video", "audio"):
        early, roots = None, []
        for i, (p, content) in enumerate(tags):
            if p not in (f"og:{kind}", f"og:{kind}:url", f"og:{kind}:secure_url", f"og:{kind}:type") or content is None:
                continue
            role = p.split(":")[2] if p.count(":") == 2 else "url"
            if role == "url" or role == "secure_url" and not roots:
                roots.append([i, kind, content, None, None])
            elif role == "secure_url":
                roots[-1][3] = content
            elif content.strip():
                if roots:
                    roots[-1][4] = content
                else:
                    early = content
        out += [[*r[:4], r[4] or early] for r in roots]
    return [tuple(r[1:]) for r in sorted(out)]


def page(tags):
    return "<html><head>" + "".join(f'<meta property="{p}"' + ("" if c is None else f' content="{c}"') + ">" for p, c in tags) + "</head></html>"


def test_binding_against_plain_reading(spark):
    rnd = random.Random(1)
    names = [f"og:{k}{r}" for k in ("video", "audio") for r in ("", ":url", ":secure_url", ":type")] + ["og:title", "twitter:player"]
    made = [[(rnd.choice(names), rnd.choice([f"c{i}", f"c{i}", "", " "])) for i in range(rnd.randint(0, 14))] for _ in range(150)]
    made += [[("og:video:type", "a"), ("og:video:type", "b"), ("og:video:secure_url", "s"), ("og:video:secure_url", "t"), ("og:video", "r")], [("og:audio:type", "only")], []]
    df = spark.createDataFrame([(i, "http://h/", page(x)) for i, x in enumerate(made)] + [(999, "http://h/", None)], "page_id int, url string, html string")
    got = {}
    for r in pages.bind_og_properties(df).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.root, r.secure_url, r.type))
    for i, tags in enumerate(made):
        assert got.get(i, []) == bound(tags), (tags, got.get(i))


def test_running_count(spark):
    rows = [([i % 3 == 0 for i in range(n)],) for n in (0, 1, 63, 64, 65, 1000)]
    for r in spark.createDataFrame(rows, "f array<boolean>").select("f", running_count(F.col("f")).alias("n")).collect():
        assert r.n == [sum(r.f[: i + 1]) for i in range(len(r.f))]


def test_time_grows_with_the_tags(spark):
    """Eight times the tags take far less than sixty-four times the time."""
    took = []
    for n in (2_000, 2_000, 16_000):
        tags = [(f"og:video{('', ':secure_url', ':type')[i % 3]}", f"v{i}") for i in range(n)]
        df = spark.createDataFrame([(1, "http://h/", page(tags))], "page_id int, url string, html string")
        start = time.time()
        assert pages.bind_og_properties(df).agg(F.count("type"), F.max("pos")).first()[:] == (n // 3, n // 3 if n % 3 else n // 3 - 1)
        took.append(time.time() - start)
    assert took[2] < 24 * took[1] + 2, took
