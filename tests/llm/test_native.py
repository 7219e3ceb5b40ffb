"""Personal data, url filters and quality rules against plain Python, with odd rows."""

import collections
import hashlib
import time
import math
import random
import re

import pytest

import numpy as np

from tallyhouse.llm import pii, quality, queries_native, urls
from tallyhouse.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind int, component string"
ODD = [
    None, "", " \t\n", "mail a.b+c@x-y.example.com. and b@c", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "pay 4111 1111 1111 1111 or 4111-1111-1111-1112 now",
    "call +1 (469) 555-8958, +12 3 +1234567890123456 ++1 2345678901", "é😀 x@y.zz 😀 10.0.0.1", "a@b.c@d.e _f@g.h", "1" * 30000, "a" * 30000 + "@", "9 " * 9000, "1.1.1.1\n\n1.1.1.1", "x" * 70000 + " 8.8.8.8",
]


def frame(spark, texts, more=()):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", 0, 1, "c") for i, t in enumerate(texts)] + list(more), DOCS)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    text = text or ""
    out = []
    for n, (kind, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        if kind == "email" and "@" not in text.rstrip("@"):
            continue  # the plain form takes too long on one long run
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def test_base_spans(spark):
    got = {r.doc_id: r for r in pii.find(frame(spark, ODD), Scratch(spark)).withColumn("s", pii.joined(pii.F.col("base"))).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i].s == ",".join(plain_spans(t)), i


def test_personal_data_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries_native.op1_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_bootstrap_finds_unseen(spark):
    texts = [f"Please write to contact address user{i}@mail.example.com today" for i in range(40)] + ["write to contact address ticket-88213-x today", "in the summer of model99 1999"]
    rows = pii.find(frame(spark, texts), Scratch(spark)).orderBy("doc_id").collect()
    assert [len(r.added) for r in rows] == [0] * 40 + [1, 0]
    a = rows[40].added[0]
    assert texts[40][a.start : a.stop] == "ticket-88213-x" and pii.KINDS[a.kind] == "email"


def added(spark, texts):
    """(text of the span, kind) of each added span, by document."""
    return [[(texts[r.doc_id][a.start : a.stop], pii.KINDS[a.kind]) for a in r.added] for r in pii.find(frame(spark, texts), Scratch(spark)).orderBy("doc_id").collect()]


def test_bootstrap_with_more_unseen_than_seeds(spark):
    """Twenty seeds, thirty unseen numbers in groups; what a pattern without seeds extracts is left alone."""
    texts = [f"please ring this number +1 469 555 {1000 + i} after lunch" for i in range(20)] + [f"please ring this number 0171 {200 + i} {5000 + i}, thanks" for i in range(30)]
    texts += [f"the invoice has total 20{i:02d} 4{i:03d} {6000 + i} today" for i in range(8)] + ["ring this number 2001 4001 6001 today", "number 4111 1111 1111 1112 here"]
    got = added(spark, texts)
    assert got[:20] == [[]] * 20 and got[58:] == [[], []] and got[50:58] == [[]] * 8
    assert got[20:50] == [[(f"0171 {200 + i} {5000 + i}", "phone")] for i in range(30)]


def test_accepted_instances_induce_patterns(spark):
    """No seed stands after "reach": its instances are known from "contact", and it then finds one of its own."""
    texts = [f"contact u{i}@mail.example.com" for i in range(20)] + [f"contact agent-{i}77" for i in range(5)] + [f"reach agent-{i}77" for i in range(5)] + ["reach agent-999"]
    got = added(spark, texts)
    assert got[20:] == [[(t.split()[1], "email")] for t in texts[20:]] and got[:20] == [[]] * 20


def test_contexts_reach_whole_words(spark):
    """A word of any length is a context, and a match before stands as #."""
    rows = pii.with_candidates(frame(spark, ["x" * 90 + " 1.2.3.4 and 5.6.7.8 9.9.9.9", "A  b\nC 1.2.3.4"])).orderBy("doc_id").collect()
    assert [b.ctx for b in rows[0].base] == [["x" * 90], ["and", "# and"], []] and [b.ctx for b in rows[1].base] == [["c", "b c"]]


def test_outside(spark):
    """Candidates against all base spans, by brute force, over more than one block."""
    rng = random.Random(2)
    spans = lambda n: [(a, a + rng.randint(1, 9)) for a in (rng.randrange(3000) for _ in range(n))]
    base, cand = sorted(spans(150)), sorted({a: (a, b) for a, b in spans(300)}.values())
    one = "array<struct<start:bigint,stop:bigint,hit:string,ctx:array<string>>>"
    df = spark.createDataFrame([([(a, b, "", []) for a, b in base], [(a, b, str(a), []) for a, b in cand])], f"base {one}, cand {one}")
    got = [(x.start, x.stop) for x in df.select(pii._outside(pii.F.col("cand"), pii.F.col("base")).alias("o")).first().o]
    assert got == [(a, b) for a, b in cand if not any(x < b and a < y for x, y in base)] and got
    sums = spark.range(1).select(pii.running(pii.F.sequence(pii.F.lit(1), pii.F.lit(1000)).cast("array<bigint>"), lambda a, x: a + x, pii.F.lit(0).cast("bigint")).alias("s")).first().s
    assert sums == [i * (i + 1) // 2 for i in range(1, 1001)]


def test_redaction(spark):
    rows = pii.find(frame(spark, ODD), Scratch(spark)).withColumn("out", pii.redacted(pii.whole(pii.F.col("text")), pii.F.col("base"))).collect()
    for r in rows:
        want, at = "", 0
        merged = []
        for s in r.base:
            if merged and s.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.stop)
            else:
                merged.append([s.start, s.stop, s.kind])
        for a, b, k in merged:
            want += (r.text or "")[at:a] + f"<{pii.KINDS[k]}>"
            at = b
        assert r.out == want + (r.text or "")[at:]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert pii.find(none, Scratch(spark)).count() == 0
    assert quality.judge(quality.with_statistics(none), Scratch(spark)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, queries_native.URL_RULES, Scratch(spark)).count() == 0


WS = " \t\n\x0b\f\r"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = {}, set()
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.strip(WS)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    texts = [*ODD, "a b c d e a b c d e", "x y " * 50, "l one\nl one\n\n \n l one\nl one", "🙂 b\x1cc\x85d e\u00a0f # $ |<>", "a b c d e f g", "w " * 20000]
    for r in quality.with_statistics(frame(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text), r.doc_id


def test_quality_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries_native.op4_quality_outliers(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good = [x.doc_id for x in labels if x.quality == 1]
    bad = [x.doc_id for x in labels if x.quality == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_outlier_cutoff(spark):
    """A text with 120 bars lies over the 0.9999 quantile, at which one in 10,000 ordinary documents would go."""
    assert abs(math.exp(-quality.CUTOFF / 2) * (1 + quality.CUTOFF / 2) - 1e-4) < 1e-8
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(200)) for _ in range(300)]
    junk = texts[0].replace(" ", "| ", 120)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*texts, junk])], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality.judge(Scratch(spark).keep(quality.with_statistics(docs)), Scratch(spark)).collect()}
    assert not rows[300].base_failed and quality.CUTOFF < rows[300].d2 < 45 and not rows[300].kept
    assert all(rows[i].kept for i in range(300))


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", None), (2, "https://example.net/fr/", ""), (3, "http://net", None), (4, "http://x.org/fr/a", None), (5, "http://y.com/p", '<link rel="canonical" href="http://bad.net/q">'),
        (6, "http://z.com/p", "<META http-equiv=refresh content='0; url=/t'>"), (7, "http://z.com/t", '<link href="https://y.com/p" rel=canonical>'), (8, None, '<link rel="canonical" href="http://bad.net/">'), (9, "nourl", None),
        (10, "http://ok.org/fr/1", '<link rel="canonical" href="http://bad.net/q">'), (11, "http://w.com/p#f", None), (11, "http://w.com/p#f", None), (12, "ftp://notexample.com/de/", None), (13, "http://example.com/de/", None), (14, "http://example.net/x://y/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", urls.F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(pages, queries_native.URL_RULES, Scratch(spark)).collect()}
    v = {k: (r.rule, r.verdict) for k, r in got.items()}
    assert v[1] == ("example.net/en/", "allow") and v[2] == ("net/", "block") and v[3] == (None, "allow") and v[4] == ("org/fr/", "allow")
    assert v[5] == v[6] == v[7] == (None, "block")
    assert v[8] == v[9] == v[11] == v[12] == (None, "allow") and v[10] == ("org/fr/", "allow") and v[13] == ("example.com/de/", "block")
    assert (got[1].host, got[1].path) == ("a.example.net", "/en/1") and (got[8].host, got[8].path) == ("", "") and v[14][1] == "block"
    seen = spark.createDataFrame([("http://w.com/p", "http://z.com/p")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, queries_native.URL_RULES, Scratch(spark), seen).collect()}[11] == "block"


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_node(url):
    host, path = plain_parts(url)
    query = re.match(r"[^#?]*(\?[^#]*)", url)
    return host + (path or "/") + (query[1] if query else "")


def plain_links(url, html):
    from urllib.parse import urljoin

    for tag in re.findall(r"(?i)<(?:link|meta)\b[^>]*>", html or ""):
        if re.search(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b", tag):
            m = re.search(r"(?i)(?:\bhref\s*=\s*|;\s*url\s*=\s*)[\"']?([^\"'>\s]+)", tag)
            if m:
                yield urljoin(url, m[1].replace("&amp;", "&"))


def test_url_query(spark):
    """Rules and verdicts of all pages against plain Python: components by repeated merging."""
    d = "/root/testdata/sf0.01"
    rows = queries_native.op3_url_redirect_filter(spark, d).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    group = {}
    for p in pages.values():
        if "://" in (p.url or ""):
            for link in plain_links(p.url, p.html):
                if "://" in link:
                    both = group.get(plain_node(p.url), {plain_node(p.url)}) | group.get(plain_node(link), {plain_node(link)})
                    group.update(dict.fromkeys(both, both))
    blocked = {n for n, g in group.items() if any(plain_rule(*re.match(r"([^/?]*)([^?]*)", x).groups())[1] == "block" for x in g)}
    assert len(rows) == len(pages)
    for r in rows:
        url = pages[r.page_id].url
        rule, verdict = plain_rule(*plain_parts(url))
        assert (r.host, r.path, r.rule) == (*plain_parts(url), rule)
        assert r.verdict == (verdict or ("block" if "://" in (url or "") and plain_node(url) in blocked else "allow")), url


def test_candidates_in_linear_time(spark):
    """Runs that have no end to find: a hundred thousand characters of each, in seconds, and the same candidates as a plain scan."""
    long = [unit * (100_000 // len(unit)) for unit in ("@", "=@", ".@", "a-", "1 ", "12 34x ", "9.", "+1(", "a@b=")]
    began = time.time()
    rows = pii.with_candidates(frame(spark, long)).select(pii.F.size("cand").alias("n")).collect()
    assert len(rows) == len(long) and time.time() - began < 60
    rng = random.Random(6)
    texts = ["".join(rng.choice("a1@.=+- (/_,2") for _ in range(rng.randrange(30))) for _ in range(400)]
    # maximal runs with a digit or @, cut at their last letter or digit, where no groups of digits begin
    grouped = re.compile(r"\+?\(?[0-9]+(?:[\x20./()-]{1,2}[0-9]+(?![A-Za-z0-9@_=]))+")
    inside = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@_.+=-")
    for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pii.F.regexp_extract_all("t", pii.F.lit(pii.CANDIDATE), pii.F.lit(0)).alias("c")).collect():
        text, at = texts[r.i], 0
        for hit in r.c:
            at = text.index(hit, at)
            assert at == 0 or text[at - 1] not in inside or hit[0] == "("
            if not grouped.fullmatch(hit):
                run = re.match(r"[A-Za-z0-9@_.+=-]+", text[at:])[0]
                assert hit == re.sub(r"[^A-Za-z0-9]+$", "", run) and re.search("[0-9@]", hit)
            at += len(hit)


def test_bootstrap_goes_on_while_it_finds(spark):
    """Five words, each known only from instances that the word before found: more rounds than any fixed number of three."""
    steps = ["contact", "reach", "ask", "page", "ring", "poke"]
    texts = [f"contact u{i}@mail.example.com" for i in range(20)]
    texts += [f"{w} agent-{k}{i}77" for k in range(5) for w in steps[k : k + 2] for i in range(5)]
    assert all(len(x) == 1 for x in added(spark, texts)[20:])


def plain_mcd(points, steps=3):
    """The estimate in numpy: quartiles, then the nearest three quarters three times; distances of all points."""
    grid, floors = 1024, np.array(quality.FLOORS)

    def edge(values, share):
        ordered = np.sort(values)
        return ordered[int(np.ceil(share * len(ordered))) - 1]

    bins = np.floor(points * grid)
    a, b, c = (np.array([edge(bins[:, k], s) for k in range(4)]) for s in (0.25, 0.5, 0.75))
    mean, cov = (b + 0.5) / grid, np.diag(((c - a) / grid / 1.349) ** 2 + floors**2)
    for _ in range(steps):
        dev = points - mean
        d2 = np.einsum("ij,ij->i", dev, np.linalg.solve(cov, dev.T).T)
        place = np.floor(np.minimum(np.log2(1 + d2), 60) * 32)
        core = points[place <= edge(place, 0.75)]
        mean = core.mean(0)
        cov = 1.48642 * ((core - mean).T @ (core - mean) / len(core)) + np.diag(floors**2)
    dev = points - mean
    return np.einsum("ij,ij->i", dev, np.linalg.solve(cov, dev.T).T)


def test_outliers_against_numpy(spark):
    """d2 and kept of every document of sf0.01, group by group."""
    assert abs(quality.CONSISTENCY - 1.48642) < 1e-4
    assert abs(1 - math.exp(-quality.NEAREST / 2) * (1 + quality.NEAREST / 2) - quality.KEPT) < 1e-5
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    keep = [*quality.STATS, "n_lines", "base_failed", "lang", "source", "doc_id"]
    rows = quality.judge(Scratch(spark).keep(quality.with_statistics(docs).select(*keep)), Scratch(spark)).toPandas()
    good = rows[~rows.base_failed].copy()
    pair = list(zip(good.lang.fillna("~"), good.source.fillna("~")))
    size = collections.Counter(pair)
    per_lang = collections.Counter()
    for p, n in size.items():
        per_lang[p[0]] += n if n < 100 else 0
    good["grp"] = [p if size[p] >= 100 else p[0] if per_lang[p[0]] >= 100 else "pool" for p in pair]
    n = good.n_words
    x = np.stack([np.log((good.word_chars + 275) / (n + 50)), np.sqrt(good.n_symbols / (good.word_chars + 100)), good.n_dup_lines / (good.n_lines + 8), good.n_repeat_words / (n + 50)], 1).astype(float)
    checked = 0
    for _, at in good.reset_index(drop=True).groupby("grp").groups.items():
        own = good.iloc[at]
        if len(own) < 100:
            assert own.d2.isna().all() and own.kept.all()
            continue
        d2 = plain_mcd(x[at])
        assert np.allclose(own.d2, d2, rtol=1e-6, atol=1e-9)
        assert ((d2 <= quality.CUTOFF) == own.kept).all()
        checked += len(own)
    assert checked > 500


def test_judge_without_groups(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l", None, None) for i in range(120)] + [(None, None, "en", None)], "doc_id long, text string, lang string, source string")
    table = Scratch(spark).keep(quality.with_statistics(docs))
    rows = quality.judge(table, Scratch(spark)).collect()
    assert len(rows) == 121 and [r.kept for r in rows if r.doc_id is None] == [False] and all(r.kept for r in rows if r.doc_id is not None)
    assert quality.judge(table.where("false"), Scratch(spark)).count() == 0
