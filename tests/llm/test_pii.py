import datetime
import hashlib
import re

from pyspark.sql import functions as F

from meterwise.llm import pii as P

KEY = "k"


def keyed(kind, *parts):
    return int(hashlib.sha256("|".join([hashlib.sha256(KEY.encode()).hexdigest(), kind, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def brute_feistel(text, kind, tweak="", letters=26):
    half = len(text) // 2
    sides = [text[:half], text[half:]]

    def move(c, by):
        for base, n in (("0", 10), ("a", letters), ("A", letters)):
            if (c.isdigit() and base == "0") or (c.islower() and base == "a") or (c.isupper() and base == "A"):
                return chr((ord(c) - ord(base) + by) % n + ord(base))
        return c

    for i in range(8):
        own, other = sides[i % 2], sides[1 - i % 2]
        sides[i % 2] = "".join(move(c, keyed(kind, tweak, len(text), i, j, other)) for j, c in enumerate(own, 1))
    return "".join(sides)


def checks(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n) for r in P.pseudonymised(docs, KEY, count_col="n", **options).orderBy("doc_id").collect()]


def test_values_equal_brute_force(spark):
    texts = ["mail bo.bt.42@mail8.example.com!", "Bo.Bt.42@Mail8.example.com", "4429526289707589", "4429 5262-8970 7589,", "+1 (625) 555-7196", "(625) 555-7196", "password=b7db7aa4a5fcc78305", "TOKEN = \"E36F61096DD9D67E\""]
    got = [t for t, _ in run(spark, texts)]
    name = brute_feistel("bo.bt.42", "email", "mail8.example.com")
    body = "4" + brute_feistel("42952628970758", "card", "4")
    card = next(body + str(d) for d in range(10) if checks(body + str(d)))
    phone = brute_feistel("6255557196", "phone", "1")
    assert got[0] == f"mail {name}@mail8.example.com!"
    assert got[1].lower() == f"{name}@mail8.example.com" and got[1][0].isupper()
    assert got[2] == card and re.sub(r"\D", "", got[3]) == card and got[3][4] == " " and got[3][9] == "-"
    assert got[4] == f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}"
    assert got[5] == f"({phone[:3]}) {phone[3:6]}-{phone[6:]}"
    assert got[6] == "password=" + brute_feistel("b7db7aa4a5fcc78305", "secret", letters=6)
    assert got[7] == 'TOKEN = "' + brute_feistel("e36f61096dd9d67e", "secret", letters=6).upper() + '"'


def test_what_does_not_validate_stays(spark):
    texts = ["4429526289707580", "300.1.1.1", "1.2.3", "1999-02-30", "GB83WEST12345698765432", "v1.2.3.4.5", "no @ here", "a@b", "12345", "x4429526289707589", "2300-01-01"]
    assert run(spark, texts) == [(t, 0) for t in texts]


def test_formats_hold(spark):
    out = run(spark, ["42.144.35.254", "GB82 WEST 1234 5698 7654 32", "1999-12-31 31.12.1999 12/31/1999", "5/6/2001"])
    assert [n for _, n in out] == [1, 1, 3, 1]
    octets = out[0][0].split(".")
    assert len(octets) == 4 and all(int(x) < 256 for x in octets)
    iban = out[1][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and [len(x) for x in out[1][0].split()] == [4, 4, 4, 4, 4, 2]
    a, b, c = out[2][0].split()
    assert datetime.datetime.strptime(a, "%Y-%m-%d") == datetime.datetime.strptime(b, "%d.%m.%Y") == datetime.datetime.strptime(c, "%m/%d/%Y")


def test_days_and_short_numbers_are_permuted(spark):
    days = spark.range(0, 73049).select(P._day(F.col("id"), KEY).alias("d")).agg(F.count_distinct("d"), F.min("d"), F.max("d")).first()
    assert tuple(days) == (73049, 0, 73048)
    numbers = spark.range(0, 1000).select(P.feistel(F.lpad(F.col("id").cast("string"), 3, "0"), KEY, "x").alias("v"))
    assert numbers.where(F.col("v").rlike("^[0-9]{3}$")).distinct().count() == 1000


def test_nulls_long_texts_and_other_columns(spark):
    long = "word " * 100_000 + "4429526289707589" + " a" * 50_000 + "9" * 50_000 + "a" * 50_000 + " a@b" + ".c" * 50_000
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (3, long, 7)], "doc_id long, text string, pii_count int")
    out = P.pseudonymised(docs, KEY)
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[1] is None and rows[2] == "" and len(rows[3]) == len(long) and rows[3] != long
    assert out.count() == 4 and P.pseudonymised(docs.limit(0), KEY).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_neighbours_do_not_hide_values(spark):
    card, iban, phone, address = "4429526289707589", "BE68 5390 0754 7034", "+1 (826) 555-4081", "190.137.223.204"
    spaced = "4429 5262 8970 7589"
    cases = [f"{card} 12/26", f"{card} 123", f"order 12 {card}", f"12 {spaced} 123 7", f"{iban} EUR", f"AB12 {iban} {card}", f"NO93 8601 1117 947 {spaced}", f"{phone} {address}", f"{phone} {spaced}"]
    cases += [f"+44 20 7946 0958 {address}", f"+49 30 1234 {spaced}", f"+49 30 1234567 {card}", f"{card} {address}", f"{card} 1999-12-31", f"{card} 555-123-4567", f"{card} {spaced}"]
    got = run(spark, cases + [card, iban, phone, address])
    plain_card, plain_iban, plain_phone, plain_address = (t for t, _ in got[-4:])
    told = dict(zip(cases, got, strict=False))
    groups = " ".join(plain_card[i : i + 4] for i in range(0, 16, 4))
    assert told[f"{card} 12/26"] == (f"{plain_card} 12/26", 1) and told[f"{card} 123"] == (f"{plain_card} 123", 1)
    assert told[f"order 12 {card}"] == (f"order 12 {plain_card}", 1) and told[f"12 {spaced} 123 7"] == (f"12 {groups} 123 7", 1)
    assert told[f"{iban} EUR"] == (f"{plain_iban} EUR", 1) and told[f"AB12 {iban} {card}"] == (f"AB12 {plain_iban} {plain_card}", 2)
    assert told[f"{phone} {address}"] == (f"{plain_phone} {plain_address}", 2) and told[f"{phone} {spaced}"] == (f"{plain_phone} {groups}", 2)
    assert told[f"+44 20 7946 0958 {address}"][0].endswith(" " + plain_address) and told[f"{card} {address}"] == (f"{plain_card} {plain_address}", 2)
    assert told[f"+49 30 1234 {spaced}"][0].endswith(" " + groups) and told[f"+49 30 1234567 {card}"][0].endswith(" " + plain_card)
    assert told[f"{card} {spaced}"] == (f"{plain_card} {groups}", 2)
    assert told[f"NO93 8601 1117 947 {spaced}"][1] == 2 and told[f"NO93 8601 1117 947 {spaced}"][0].endswith(" " + groups)
    assert [told[f"{card} {x}"][1] for x in ("1999-12-31", "555-123-4567")] == [2, 2]


def test_plans_do_not_tell_the_key(spark):
    docs = spark.createDataFrame([("mail a.b@example.org or 4111 1111 1111 1111",)], "text string")
    secret = "a secret of some length"
    plan = P.pseudonymised(docs, secret)._jdf.queryExecution().toString()
    assert secret not in plan and hashlib.sha256(secret.encode()).hexdigest() not in plan and "redacted" in plan
    assert P.pseudonymised(docs.limit(0), secret).count() == 0
