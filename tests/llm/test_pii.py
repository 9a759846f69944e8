import hashlib
import random
import re
import time

from corvine.llm import pii as P
from corvine.session import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def odd_texts():
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "+", "1", "4845168114407329", "4845 1681-1440 7329", "255", "0001", "1.2.3.4", "300.1.1.1", " ", "-", "é", "🤗", "_x", "%", "+1 (017) 555-7713", "x@y", "a@b.c_x@d.ef", "(", ")", "日", "999999999999999999999999"]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(400)]


def check(spark, rows):
    got = {r.doc_id: r for r in P.find_personal(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    for i, t, _ in rows:
        want = brute(t)
        base = [s for s in got[i].spans.split(",") if s.split(":")[0] in PLAIN]
        assert base == want, t[:200]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def test_base_spans_equal_brute_force(spark, sf):
    rows = [(i, t, "s") for i, t in enumerate(odd_texts())]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "1" * 50_000 + " " + "a" * 50_000 + "@", "s"), (1003, "1 " * 30_000 + "x@y" + ".z" * 30_000, "s")]
    check(spark, rows)


def test_base_spans_of_documents(spark, sf):
    check(spark, [(r.doc_id, r.text, "s") for r in table(spark, sf, "documents").collect()])


def test_secrets_are_added_and_words_are_not(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    found = P.find_personal(docs).filter("n_more > 0").join(docs, "doc_id").collect()
    assert found
    for r in found:
        for s in r.spans.split(","):
            kind, a, b = s.split(":")
            if kind == "secret":
                assert re.fullmatch("[0-9a-fA-F]{32,64}", r.text[int(a) : int(b)])
    n = sum(len(re.findall(r'(?i)token = "[0-9a-f]{40}"', r.text)) for r in docs.collect())
    assert sum(r.spans.count("secret:") for r in found) >= 0.95 * n


def test_redaction(spark):
    rows = [(1, "é a@b.cd und +1 (017) 555-7713 z"), (2, None), (3, "nothing")]
    d = P.annotate(spark.createDataFrame(rows, "doc_id long, text string"), [])
    got = {r.doc_id: r.t for r in d.select("doc_id", P.redact(d.text, d.spans).alias("t")).collect()}
    assert got == {1: "é [EMAIL] und [PHONE] z", 2: None, 3: "nothing"}
    assert P.find_personal(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_many_spans_in_one_text(spark):
    n = 32_000
    text = " ".join(f"a{i}@b.cd" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    d = P.annotate(docs, [])
    d.select("spans").collect()  # compiled
    began = time.time()
    spans, masked = d.select("spans", P.redact(d.text, d.spans).alias("t")).first()
    assert time.time() - began < 20
    assert [text[s.start : s.end] for s in spans] == text.split(" ")
    assert masked == " ".join(["[EMAIL]"] * n)


def test_spans_apart_and_redacted_like_a_plain_version(spark):
    rng = random.Random(8)
    rows, want = [], []
    for i in range(60):
        text = "".join(rng.choices("aé🤗 b", k=300))
        spans = sorted({(a, rng.randrange(7), a + rng.randrange(1, 15)) for a in rng.sample(range(280), rng.randrange(1, 40))})
        kinds = list(P.ORDER)
        rows.append((i, text, [(a, o, b, kinds[o]) for a, o, b in spans]))
        free = [x for x in spans if x[1] < 4 or not any(y[1] < 4 and y[0] < x[2] and x[0] < y[2] for y in spans)]
        at, out = 0, ""
        for a, o, b in spans:
            if a >= at:
                out += text[at:a] + f"[{kinds[o].upper()}]"
            at = max(at, b)
        want.append((i, free, out + text[at:]))
    d = spark.createDataFrame(rows, f"doc_id long, text string, s array<{P.SPAN}>")
    got = d.select("doc_id", P.apart(d.s).alias("a"), P.redact(d.text, d.s).alias("t")).collect()
    assert sorted((r.doc_id, [(x.start, x.ord, x.end) for x in r.a], r.t) for r in got) == want


def test_planted_names_and_local_phones(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    phone = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    name = lambda: f"{rng.choice(['Mr', 'Dr.', 'Frau'])} {word(5).title()} {word(6).title()}"
    rows, personal = [], []
    for i in range(900):
        filler = " ".join(word(rng.randrange(3, 8)) for _ in range(12))
        kind = i % 6
        text, there = {
            0: (f"{filler}, phone: ({rng.randrange(200, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} {filler}", 1),
            1: (f"{filler}. tel: {phone()} {filler}", 1),
            2: (f"{filler}. Signed: {name()}, {filler}", 1),
            3: (f"{filler} part {rng.choice(['111-111-1111', '222-222-2222', '333-333-3333'])} {filler}", 0),
            4: (f"{filler}. key = {rng.randbytes(20).hex()} {filler}", 1),
            5: (f"{filler} {word(24)} {filler}", 0),
        }[kind]
        rows.append((i, text))
        personal.append(there)
    got = {r.doc_id: r.n_more for r in P.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(1 for i, p in enumerate(personal) if p and got[i])
    false = sum(1 for i, p in enumerate(personal) if not p and got[i])
    assert hit >= 0.95 * sum(personal) and false <= 0.05 * (len(personal) - sum(personal))
