import base64

from pyspark.sql import functions as F

from tickledger.functions import paths

PATHS = [
    ("hello/world", "hello", "/world"),
    ("hello", "hello", "/"),
    ("/hello/world", "hello", "/world"),
    ("hello/", "hello", "/"),
    ("", "", "/"),
    ("/a/../b//./c", "b", "/c"),
    ("/../../x", "x", "/"),
    ("/a/b/../../..", "", "/"),
    ("/a..b/.c", "a..b", "/.c"),
]


def b64(text):
    return base64.b64encode(text.encode()).decode()


HEADERS = [
    ("Basic " + b64("Aladdin:open sesame"), "Aladdin"),
    ("BASIC " + b64("Aladdin:open sesame"), "Aladdin"),
    ("basic " + b64("Aladdin:open sesame"), "Aladdin"),
    ("Basic " + b64("Aladdin:open:sesame"), "Aladdin"),
    ("Basic " + b64(":"), ""),
    ("Basic" + b64("Aladdin:open sesame"), None),
    (b64("Aladdin:open sesame"), None),
    ("Basic ", None),
    ("Basic Aladdin:open sesame", None),
    ('Digest username="Aladdin"', None),
    ("Basic " + b64("no colon"), None),
    (None, None),
]


def test_shift_path(spark):
    df = spark.createDataFrame([(p,) for p, _, _ in PATHS], "path string")
    got = {r.path: (r.p.head, r.p.tail) for r in df.select("path", paths.shift_path(F.col("path")).alias("p")).collect()}
    assert got == {p: (h, t) for p, h, t in PATHS}


def test_basic_user(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADERS)], "i int, header string")
    got = {r.i: r.user for r in df.select("i", paths.basic_user(F.col("header")).alias("user")).collect()}
    assert got == {i: user for i, (_, user) in enumerate(HEADERS)}


def test_url_path(spark):
    urls = {
        "https://m.example.net/en/25?x=/y#/z": "/en/25",
        "//host/p": "/p",
        "/es/12": "/es/12",
        "http://host": "",
        "rel/a": "rel/a",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.p for r in df.select("url", paths.url_path(F.col("url")).alias("p")).collect()} == urls
