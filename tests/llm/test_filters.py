"""Quality rules, chat formatting, WARC packages, URL filters."""

import gzip
import json
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from rulespan.llm import chat_format as C
from rulespan.llm import quality_rules as R
from rulespan.llm import url_filter as L
from rulespan.llm import warc_zip as W


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(40)) for _ in range(n))


# --- quality


def brute_statistics(t):
    import re

    t = t or ""
    w = re.findall(r"\w+", t.lower())
    return {"n_words": len(w), "distinct_share": len(set(w)) / len(w) if w else 0, "repeat_share": sum(a == b for a, b in zip(w, w[1:])) / len(w) if w else 0, "mean_line": len(w) / (t.count("\n") + 1) if t else 0}


def test_statistics():
    texts = ["A b b. C\nD", None, "", "SHOUT!! LOUD!! ok", "x# y$ z"]
    s = R.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        for name, v in brute_statistics(t).items():
            assert s[name][k] == pytest.approx(v), (t, name)
    assert s["upper_share"][3] == pytest.approx(2 / 3) and s["sign_share"][4] == pytest.approx(2 / 3)


def all_statistics(t):
    """All twelve, word by word."""
    raw = (t or "").encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z_\x80-\xff]+", raw)]
    w = [raw[a:b].decode().lower() for a, b in spans]
    n, signs = len(w), b"#$%&*!|~^<>{}[]=+\\@"
    flags = {
        "repeat": [k > 0 and w[k] == w[k - 1] for k in range(n)],
        "upper": [not re.search(rb"[a-z]", raw[a:b]) and len(re.findall(rb"[A-Z]", raw[a:b])) >= 2 for a, b in spans],
        "sign": [any(c in signs for c in raw[b : b + 2]) for _, b in spans],
    }
    out = {"n_words": n, "mean_word": sum(b - a for a, b in spans) / n if n else 0, "distinct_share": len(set(w)) / n if n else 0, "mean_line": n / (raw.count(b"\n") + 1)}
    for name, x in flags.items():
        out[f"{name}_share"] = sum(x) / n if n else 0
        out[f"{name}_block"] = max((sum(x[k : k + 32]) / max(8, len(x[k : k + 32])) for k in range(0, n, 32)), default=0)
    out["digit_share"] = len(re.findall(rb"[0-9]", raw)) / len(raw) if raw else 0
    out["alpha_share"] = len(re.findall(rb"[A-Za-z\x80-\xff]", raw)) / len(raw) if raw else 0
    return out


def test_all_statistics():
    rng = random.Random(6)
    pool = ["word", "WORD", "Ab", "AB", "a#", "b!!", "12", "x1", "é", "ÀÉ", "\n", "-", "same same", "#", "~ ~"]
    texts = ["", None, "one", *(" ".join(rng.choice(pool) for _ in range(rng.randrange(120))) for _ in range(60))]
    s = R.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        want = all_statistics(t)
        assert set(want) == set(R.STATS)
        for name in R.STATS:
            assert s[name][k] == pytest.approx(want[name]), (t, name)


def brute_rules(rows, bad):
    """Sequential covering, condition by condition and row by row. rows: dictionaries of statistics."""
    part = np.random.default_rng(3).random(len(rows)) < 2 / 3
    holds = lambda c, r: (r[c[0]] >= c[2]) if c[1] else (r[c[0]] < c[2])
    covers = lambda cs, r: all(holds(c, r) for c in cs)
    rules, left = [], list(range(len(rows)))
    while len(rules) < R.MAX_RULES and sum(bad[k] for k in left) >= R.MIN_COVER:
        grown, cs = [k for k in left if part[k]], []
        while len(cs) < R.MAX_CONDITIONS:
            inside = [k for k in grown if covers(cs, rows[k])]
            p = sum(bad[k] for k in inside)
            if p in (0, len(inside)):
                break
            best, gain = None, 1e-9
            for name in rows[0]:
                cuts = sorted(set(np.quantile([rows[k][name] for k in inside], np.linspace(0, 1, R.QUANTILES + 1)).tolist()))
                for t in ((a + b) / 2 for a, b in zip(cuts, cuts[1:])):
                    for above in (False, True):
                        hit = [k for k in inside if holds((name, above, t), rows[k])]
                        pp = sum(bad[k] for k in hit)
                        if pp and (g := pp * (np.log2(pp / len(hit)) - np.log2(p / len(inside)))) > gain:
                            best, gain = (name, above, t), g
            if best is None:
                break
            cs.append(best)
        if not cs:
            break
        others, found = [k for k in left if not part[k]], None
        for m in range(len(cs), 0, -1):
            hit = [k for k in others if covers(cs[:m], rows[k])]
            p = sum(bad[k] for k in hit)
            worth = (2 * p - len(hit)) / len(hit) if hit else -1.0
            if found is None or worth >= found[0]:
                found = worth, cs[:m], p / len(hit) if hit else 0.0
        cs, precision = (found[1], found[2]) if others else (cs, 1.0)
        hit = [k for k in left if covers(cs, rows[k])]
        if len(hit) < R.MIN_COVER or precision < R.MIN_PRECISION or sum(bad[k] for k in hit) < R.MIN_PRECISION * len(hit):
            break
        rules.append(cs)
        left = [k for k in left if k not in set(hit)]
    return rules


@pytest.mark.parametrize("seed", range(4))
def test_rules_against_a_brute_force_learner(seed):
    rng = random.Random(seed)
    rows = [{"a": rng.randrange(12) / 4, "b": rng.random(), "c": float(rng.randrange(3))} for _ in range(150)]
    bad = np.array([(r["a"] > 2 and r["b"] < 0.6) or r["c"] == 2 and r["b"] > 0.8 or rng.random() < 0.02 for r in rows])
    rules = R.learn({s: np.array([r[s] for r in rows]) for s in rows[0]}, bad)
    got = [[(c.stat, c.above, c.threshold) for c in r.conditions] for r in rules]
    assert got and got == brute_rules(rows, bad.tolist())


def test_rules_learned_and_applied(spark, odd, clashing, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        t = prose(rng, 50)
        rows.append((k, " ".join(x + "##" for x in t.split()) if bad and k % 8 else t.upper() + "!!" if bad else t))
        labels.append((k, 0 if bad else 1))
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    train = labs.filter("doc_id < 160")
    rules = R.fit(docs, train)
    assert rules
    got = {r.doc_id: (r.keep, r.rule) for r in R.judge(docs, rules).collect()}
    held = [(k, q) for k, q in labels if k >= 160]
    assert sum(got[k][0] == bool(q) for k, q in held) / len(held) >= 0.95
    x = R.statistics(pa.array([t for _, t in rows]))
    for k, _ in rows:  # the expressions say what the list says
        first = next((n for n, r in enumerate(rules, 1) if r.holds({s: v[k : k + 1] for s, v in x.items()})[0]), 0)
        assert got[k] == (first == 0, first)
    assert {r.doc_id for r in R.kept_documents(docs, train).collect()} == {k for k, v in got.items() if v[0]}
    for d in (odd, clashing):
        assert R.judge(d, rules).count() == odd.count()
    assert R.judge(empty, rules).count() == 0 and R.fit(docs, labs.limit(0)) == [] and R.fit(empty, labs) == []
    nulls = spark.createDataFrame([(None, 1), (1, None), (999, 0)], "doc_id long, quality int")
    assert R.fit(docs, nulls) == [] and R.judge(docs, []).filter("keep").count() == 240


# --- chat


def test_chat_against_a_turn_by_turn_version(spark):
    rows = [(1, 0, "user", "Hello <|im_end|> you"), (1, 1, "assistant", "Hi\n there"), (1, 2, "user", None), (2, 5, None, "x"), (2, None, "assistant", "last"), (None, 0, "assistant", ""), (1, 1, "assistant", "Hi\n there")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    e = C.encoding(C.VOCABULARY)
    got = {r.conv_id: r for r in C.chat_tokens(df.selectExpr("*", "1 as ids", "2 as t")).collect()}

    def brute(turns):
        ids, mask = [], []
        for role, text in turns:
            head = [50257, *e.encode_ordinary(role), *e.encode_ordinary("\n")]
            body = e.encode_ordinary((text or "").replace("<|im_end|>", "<​|im_end|>"))
            learn = int(role == "assistant")
            ids += [*head, *body, 50258, *e.encode_ordinary("\n")]
            mask += [0] * len(head) + [learn] * (len(body) + 1) + [0]
        return ids, mask

    for conv, turns in ((1, [rows[0][2:], rows[1][2:], rows[1][2:], rows[2][2:]]), (2, [("unknown", "x"), ("assistant", "last")]), (None, [("assistant", "")])):
        assert (got[conv].ids, got[conv].mask) == brute(turns), conv
        assert got[conv].n_turns == len(turns) and got[conv].n_tokens == len(got[conv].ids) and got[conv].n_learned == sum(got[conv].mask)
    assert C.chat_tokens(df.limit(0)).count() == 0
    assert got[1].ids.count(50258) == 4  # the one in the content gave no reserved id
    long = spark.createDataFrame([(1, 0, "assistant", "word " * 100_000)], df.schema)
    assert C.chat_tokens(long).collect()[0].n_tokens > 100_000


# --- WARC


PAGES = [(1, "http://a.example/x", "<p>é</p>"), (2, None, None), (3, "http://a.example/x", ""), (3, "http://a.example/x", ""), (None, "u", "y" * 400_000), (5, 'a "q"\nb', "z\r\n\r\nz")]


def test_packages_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    for zip64 in (False, True):
        made = W.write_packages(df.selectExpr("*", "1 as path", "2 as n"), package_bytes=300, zip64=zip64)
        paths = [r.path for r in made.collect()]
        assert len(paths) > 1
        assert sorted(map(tuple, W.read_packages(spark, paths).collect()), key=key) == sorted(PAGES, key=key)
        with zipfile.ZipFile(paths[0]) as z:  # others can read it
            assert z.testzip() is None and sorted(z.namelist()) == [W.ARCHIVE, W.INDEX]
        assert W.read_packages(spark, made).count() == len(PAGES)
    assert W.through_packages(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["int", "smallint", "string"])
def test_packages_with_ids_of_any_type(spark, kind):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(f"cast(page_id as {kind}) as page_id", "url", "html", "array(1) as path")
    out = W.through_packages(df)
    assert out.dtypes[0] == df.dtypes[0]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.drop("path").collect()))


def test_records_of_others(spark, tmp_path):
    def record(kind, url, block, **more):
        head = {"WARC-Type": kind, "Content-Type": "application/http;msgtype=response", **more, "Content-Length": len(block)} | ({"warc-target-uri": url} if url else {})
        return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"

    http = lambda body, *fields: b"HTTP/1.1 200 OK\r\n" + b"".join(f.encode() + b"\r\n" for f in fields) + b"\r\n" + body
    packed = gzip.compress("<p>ö</p>".encode())
    records = [
        record("warcinfo", None, b"software: x\r\n", **{"Content-Type": "application/warc-fields"}),
        record("request", "http://a/1", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "http://a/1", http("<p>é</p>".encode("latin-1"), "content-type: text/html; charset=ISO-8859-1")),
        record("response", "<http://a/2>", http(packed, "Content-Encoding: gzip")),
        record("response", "http://a/3", http(b"4\r\nabcd\r\n2;x\r\nef\r\n0\r\n\r\n", "Transfer-Encoding: chunked")),
        record("response", "http://a/4", http(b"plain", "Transfer-Encoding: chunked", "Content-Encoding: gzip", "Content-Type: text/html; charset=nonsense")),
        record("resource", "http://a/5", b"as it is", **{"Content-Type": "text/plain"}),
        record("revisit", "http://a/6", b""),
    ]
    want = [("http://a/1", "<p>é</p>"), ("http://a/2", "<p>ö</p>"), ("http://a/3", "abcdef"), ("http://a/4", "plain"), ("http://a/5", "as it is")]
    zipped = [gzip.compress(r) for r in records]
    lines = [f"com,a)/ 2024 {json.dumps({'filename': 'data.warc.gz', 'offset': str(sum(map(len, zipped[:k]))), 'length': str(len(z))})}\n" for k, z in enumerate(zipped)]
    for name, archive, data, index in (("g", "data.warc.gz", zipped, None), ("p", "data.warc", records, None), ("i", "data.warc.gz", zipped, ["!meta {}\n", *lines])):
        path = str(tmp_path / f"{name}.wacz")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            z.writestr(f"archive/{archive}", b"".join(data))
            if index:
                z.writestr("indexes/index.cdx.gz", gzip.compress("".join(index).encode()))
        got = W.read_packages(spark, [path], "int").collect()
        assert [r.page_id for r in got] == [None] * 5 and sorted((r.url, r.html) for r in got) == want


def test_foreign_packages(tmp_path):
    records = [gzip.compress(W.warc_record(k, f"u{k}", "x" * k)) for k in (1, 2, 70_000)]
    path = str(tmp_path / "p.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr(W.ARCHIVE, b"".join(records))
        z.writestr("other.txt", "x")
    found = W.records_of(path)  # without an index: by walking
    assert [n for _, _, n in found] == [len(r) for r in records]
    with open(path, "rb") as f:
        assert [W.parse_record(W.read_at(f, at, n))[0] for _, at, n in found] == [1, 2, 70_000]
    with zipfile.ZipFile(str(tmp_path / "c.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(W.ARCHIVE, b"x" * 100)
    for name, data in (("c.zip", None), ("n.zip", b"nothing here"), ("e.zip", b"")):
        if data is not None:
            (tmp_path / name).write_bytes(data)
        with pytest.raises(W.BadPackage):
            W.records_of(str(tmp_path / name))


# --- URLs


def test_digest_sets_and_collisions(spark):
    rng = random.Random(4)
    words = [f"h{rng.randrange(500)}.example/p{rng.randrange(50)}" for _ in range(800)]
    inside = set(words[:300])
    df = spark.createDataFrame([(w,) for w in words[:300]] + [(None,), ("",)], "s string").repartition(3)
    for bits in (64, 8, 1):  # fewer bits: many strings have one digest
        found = L.build(df, bits).contains(words)
        assert list(found) == [w in inside for w in words], bits
    nothing = L.build(df.limit(0))
    assert not nothing.contains(words).any() and not L.build(df).contains([]).any()


def test_blocked_pages(spark):
    rows = [(1, "http://www.a.example/x.html?utm_source=f"), (2, "https://a.example/x/"), (3, "https://spam.example/1"), (4, "https://spam.example/2"), (5, None), (6, ""), (2, "https://a.example/x/"), (7, "https://b.example/é"), (8, "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as blocked_by", "2 as blocked_by__form")
    forms, hosts = L.corpus_block_list(df, 0.2)
    got = [(r.page_id, r[-1]) for r in L.mark(df, L.build(forms), L.build(hosts)).collect()]
    assert sorted(got, key=str) == sorted([(1, "url"), (2, "url"), (3, "host"), (4, "host"), (5, None), (6, None), (2, "url"), (7, None), (8, None)], key=str)
    assert L.blocked_pages(df.limit(0)).count() == 0
    assert np.array_equal(L.digest(["a"], 64) >> np.uint64(56), L.digest(["a"], 8))
