from __future__ import annotations

import math
import random
import re
from collections import Counter

from quirelake.llm import secrets

HEX = "0123456789abcdef"
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def brute(text: str, allow: str = r"(?!)") -> set[tuple[str, int, int]]:
    """Spans of merged windows, each counted anew."""
    out = set()
    for k in secrets.CLASSES:
        for m in re.finditer("[" + re.escape(k.alphabet) + "]+", text):
            high = [i for i in range(m.start(), m.end() - k.window + 1) if entropy(text[i : i + k.window]) >= k.least - 1e-9]
            for a in re.finditer(allow, m.group()):
                high = [i for i in high if i - m.start() >= a.end() or i - m.start() + k.window <= a.start()]
            start = None
            for i, nxt in zip(high, [*high[1:], None]):
                start = i if start is None else start
                if nxt is None or nxt - i > k.window:
                    out.add((k.name, start, i + k.window - start))
                    start = None
    return out


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "de", "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start string, n_chars long")


def test_matches_brute_force(spark):
    r = random.Random(5)
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    texts = [None, "", "plain words only", "ü" * 3 + pick(HEX, 40), pick(HEX, 19), pick(B64, 24), "a" * 9000, pick(HEX, 9000)]
    texts += [f"é {pick(HEX, r.randint(15, 60))} mid {pick(B64, r.randint(15, 60))} end" for _ in range(60)]
    texts += [pick("ab", 30) + pick(HEX, 30) + pick("a", 80) + pick(HEX, 40)] * 2
    texts = [t and t.replace("0123456789", "x") for t in texts]
    got: dict[int, set] = {}
    for x in secrets.findings(rows(spark, texts), allow=()).collect():
        got.setdefault(x.doc_id, set()).add((x.kind, x.start, x.n_chars))
    want = {i: b for i, t in enumerate(texts) if t and (b := brute(t))}
    assert got == want
    assert want


def test_allow_list_and_redaction(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [None, "", f"token = {secret} end", "1" * 10 + "2837465019" * 3, "0123456789abcdef0123456789abcdef", f"{secret} {secret}"]
    docs = rows(spark, texts)
    assert {x.doc_id for x in secrets.findings(docs).collect()} == {2, 5}
    assert secrets.findings(docs.limit(0)).count() == 0
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert got[2] == ("token = [secret] end", 20)
    assert got[5][0] == "[secret] [secret]"
    assert [got[i][0] for i in (0, 1, 3, 4)] == [texts[i] for i in (0, 1, 3, 4)]


ALLOW = "|".join(f"(?:{x})" if not x.startswith("(?i)") else f"(?i:{x[4:]})" for x in secrets.ALLOWED)


def test_query_matches_brute_force(spark):
    """The query over a table, with the allow list in use."""
    from quirelake.llm import queries

    folder = "/root/testdata/sf0.01"
    want = {(r.doc_id, *x) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for x in brute(r.text, ALLOW)}
    got = {(x.doc_id, x.kind, x.start, x.n_chars) for x in queries.op9_secrets(spark, folder).collect()}
    assert got == want and len(want) > 5


def test_allowed_strings_hide_nothing_beside_them(spark):
    r = random.Random(8)
    key, caps = "".join(r.choice(B64[:62]) for _ in range(40)), "AKIA" + "".join(r.choice(B64[:26] + "0123456789") for _ in range(16))
    texts = [f"example_key={key}", f"id {caps} end", "THE INTERNATIONALISATIONS OF AAAABBBBCCCCDDDDEEEE", "placeholder" * 4, f"xxxx{key}xxxx"]
    got = {(x.doc_id, x.kind): (x.start, x.n_chars) for x in secrets.findings(rows(spark, texts)).collect()}
    assert set(got) == {(0, "base64"), (1, "capitals"), (4, "base64")}
    assert got[1, "capitals"] == (3, 20) and got[0, "base64"][0] >= 7 and sum(got[0, "base64"]) >= 50
    assert {(i, *x) for i, t in enumerate(texts) for x in brute(t, ALLOW)} == {(i, k, *x) for (i, k), x in got.items()}


def test_odd_rows(spark):
    """Repeats, ties of windows, a null id, very long texts; extra columns pass through redaction."""
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    docs = rows(spark, [secret, "word " * 100_000 + secret, None, ""])
    docs = docs.unionAll(docs.where("doc_id = 0")).unionAll(docs.where("doc_id = 0").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "kind", "start", "n_chars"))
    got = sorted((str(x.doc_id), x.start, x.n_chars) for x in secrets.findings(docs).collect())
    assert got == [("0", 0, 40), ("0", 0, 40), ("1", 500_000, 40), ("None", 0, 40)]
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == 6
    assert sorted(x.text[-8:] for x in out.where("text <> ''").collect()) == ["[secret]"] * 4
