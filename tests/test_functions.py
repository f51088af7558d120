import hashlib
import hmac
import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from siemloom.functions import crypto, times

ISO = [
    "2024-01-01", "20240101", "2024-01-01T10", "2024-01-01T10:00Z", "2024-01-01 10:00:01.5", "2024-01-01T10:00:00,123456+05:30",
    "20240101T100001", "2024-01-01x10:00", "2024-02-30", "2024-01-01T25:00", "10:00", "2024", "", "abc", "2024-01-01T10:00:00.123-0800",
    "1969-12-31T23:59:59Z",
    "2020-W01", "2020W01", "2020-W01-1", "2020W011", "2020-W53-7T10", "2021-W53-1", "2020-W01-12", "2020W01112", "2020W0112", "2020W011T10:00",
    "2020-W01T", "2020-W011", "2020W01-1", "2020-W00-1", "2020-W01-0", "2020-W01-8", "0001-W01-1", "9999-W52-5", "9999-W52-6", "0000-W01-1",
    "2020-W10-3-0930", "2024-01-01T10:00+01:02:03", "2024-01-01T10:00-010203", "2024-01-01T10:00+01:02:03.5", "2024-01-01T10:00:00.25-00:00:00,75",
    "2024-01-01T10:00+00:75", "2024-01-01T10:00+23:59:60", "2024-01-01T10:00+24:00", "2024-01-01T10:00+01:0203", "2024-01-01T10:00-", "2024-01-01T",
    "2024-01-01\n", "2024-01-01\U0001f60010:00", "2024-W05|10:00",
]


def _python_ms(text):
    try:
        d = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    d = d if d.tzinfo else d.replace(tzinfo=timezone.utc)
    return int(d.timestamp() * 1000)


def test_iso(spark):
    df = spark.createDataFrame([(s,) for s in ISO], "s string").select("s", times.iso_ms(F.col("s")).alias("ms"))
    assert {r.s: r.ms for r in df.collect()} == {s: _python_ms(s) for s in ISO}


def test_iso_dates_and_offsets_of_all_forms(spark):
    """Texts put together from parts, right and wrong ones, against the standard library."""
    r = random.Random(6)
    two = lambda most: f"{r.randint(0, most):02d}"

    def date():
        year, form = r.choice(["1969", "1976", "2004", "2009", "2015", "2020", "2021", "9998"]), r.randrange(6)
        month, week = f"{r.randint(1, 13):02d}", r.choice(["01", "09", "52", "53", "53", "54", "00"])
        return [f"{year}-{month}-{two(31)}", f"{year}{month}{two(31)}", f"{year}-W{week}-{r.randrange(9)}", f"{year}-W{week}", f"{year}W{week}{r.randrange(9)}", f"{year}W{week}"][form]

    def clock(hours):
        c = r.choice([":", ""])
        return c.join([two(hours), two(61), two(61)][:r.randint(1, 3)])

    texts = set()
    while len(texts) < 3000:
        t = date()
        if r.random() < 0.8:
            t += r.choice("T T-xW") + clock(24)
            if r.random() < 0.2 and len(t.split("T")[-1].replace(":", "")) == 6:
                t += "." + str(r.randrange(10)) * r.randint(1, 3)
            if r.random() < 0.5:
                t += r.choice(["Z", "+" + clock(24), "-" + clock(24)])
        texts.add(t)
    df = spark.createDataFrame([(s,) for s in sorted(texts)], "s string").select("s", times.iso_ms(F.col("s")).alias("ms"))
    got = {x.s: x.ms for x in df.collect()}
    wrong = {s: (got[s], _python_ms(s)) for s in texts if got[s] != _python_ms(s)}
    assert not wrong and sum(v is not None for v in got.values()) > 500


def test_hmac(spark):
    cases = [("k", "body"), ("s" * 64, ""), ("long" * 40, '{"a":"ü"}')]
    df = spark.createDataFrame(cases, "k string, b string").select("k", "b", crypto.sign(F.col("k"), F.col("b")).alias("h"))
    for r in df.collect():
        assert r.h == hmac.new(r.k.encode(), r.b.encode(), hashlib.sha256).hexdigest()


def test_no_secret_signs_nothing(spark):
    df = spark.createDataFrame([(None, "body"), ("", "body"), ("k", None)], "k string, b string")
    unset, empty, no_body = (r.h for r in df.select(crypto.sign(F.col("k"), F.col("b")).alias("h")).collect())
    assert unset is None and no_body is None
    assert empty == hmac.new(b"", b"body", hashlib.sha256).hexdigest()
