"""Fingerprints, fill-in-middle and periodic runs against plain Python, with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import middle, queries_free, registry, repeats, weighted
from tallyhouse.llm.common import Scratch

MID = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, n long, runs string, part int, form string, key string"
ODD = [None, "", " \t\n", "a", "A b", "a b c d", "a b c d", "é😀 x\x0by\x85z", "w " * 30000, "x" * 50000, "<P> a", "a <b", "in <M> it", "ab1  c<S\n"]


def frame(spark, texts):
    rows = [(None if i == 3 else (1 << 60) + i, t, "en", 0, "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:6], DOCS)


def table(spark, tmp_path, texts):
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sampling_is_generalised_jaccard():
    """Over many pairs of weighted sets the share of equal samples departs from the exact similarity by chance alone."""
    rng, off = np.random.default_rng(3), []
    for n, common in ((6, 3), (60, 20), (700, 400), (9000, 6000)):
        for _ in range(12):
            term = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
            place, a, b = rng.permutation(n), np.where(rng.random(n) < 0.7, 1, rng.integers(1, 9, n)), rng.integers(1, 5, n)
            a, b = np.where(place < (n + common) // 2, a, 0), np.where(place >= (n - common) // 2, np.where(rng.random(n) < 0.7, a.clip(1), b), 0)
            drawn = weighted.samples(weighted.draw([(term[a > 0], a[a > 0]), (term[b > 0], b[b > 0])]))
            exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
            off.append(((drawn[0] == drawn[1]).mean() - exact) / np.sqrt(exact * (1 - exact) / weighted.SAMPLES))
    assert abs(np.mean(off)) < 0.5 and 0.7 < np.std(off) < 1.4


def test_ranks_are_whole():
    """Ranking only terms under the bar finds the same as ranking every term; ranks are exponential."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 3000):
        term, count = np.sort(rng.integers(0, 1 << 64, n, np.uint64)), rng.integers(1, 4, n)
        bits = weighted._mixed(term[None, :] ^ weighted._SEEDS)
        rank, t = weighted._ranks(bits, np.array([np.float32(np.log(c)) for c in count], np.float32))
        assert (weighted.LEAST[(bits >> np.uint64(48)).astype(int)][:, count == 1] <= rank[:, count == 1] + weighted.SLACK).all()
        got = weighted.draw([(term, count)])
        assert (got[0][:, 0] == rank.min(1)).all() and (got[1][:, 0] == term[rank.argmin(1)]).all()
    least = np.exp(np.concatenate([weighted.draw([(np.sort(rng.integers(0, 1 << 64, 500, np.uint64)), np.ones(500, int))])[0] for _ in range(40)])) * 500
    assert abs(least.mean() - 1) < 0.08 and abs(np.median(least) - np.log(2)) < 0.06


def expected(rows):
    """rows: (key, text) in the order of keys. The digest of each edited text and the exact similarity of the pairs' terms."""
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        out.append((key, len(text), sha(text[: len(text) - n] + following[:n])))
    return out


def test_next_text_over_ranges(spark):
    """Each text meets the next by descending key, across tasks and round the end."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in queries_free.op11_weighted_sampling(spark, MID).collect()}
    assert len(got) == len(rows) == len(expected(rows))
    for i, (key, n, digest) in enumerate(expected(rows)):
        r, following = got[key], got[rows[(i + 1) % len(rows)][0]]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        a, b, c = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (r.fingerprint, r.edited_fingerprint, following.fingerprint))
        assert len(a) == weighted.SAMPLES and r.near_edited == (a == b).mean() and r.near_next == (a == c).mean()
    same = {}
    for key, text in rows:
        assert same.setdefault(text, got[key].fingerprint) == got[key].fingerprint
    long = [r for r in got.values() if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1


def test_fingerprints_of_odd_rows(spark):
    docs = frame(spark, ODD)
    got = weighted.compared(docs, Scratch(spark)).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted((k or 0, n, d) for k, n, d in expected(rows))
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[(1 << 60) + 1] == prints[(1 << 60) + 2] == "0" * weighted.DIGITS
    one = spark.createDataFrame([(7, "one two three four five six")], "doc_id int, text string")
    (r,) = weighted.compared(one, Scratch(spark)).collect()
    assert r.doc_id == 7 and r.near_next == 1.0 and r.edited_sha256 == sha("one two three four" + "one two t")
    assert weighted.compared(docs.where("false"), Scratch(spark)).count() == 0
    column = weighted.with_fingerprint(docs).withColumn("like", weighted.likeness(F.col("fingerprint"), F.col("fingerprint")))
    assert {r.doc_id: r.fingerprint for r in column.collect()} == prints and {r.like for r in column.collect()} == {1.0} and set(docs.columns) < set(column.columns)


def test_runs_and_cuts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab1 é😀<") for _ in range(rng.randrange(12)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        runs = middle.Runs(text)
        assert runs.units == len(units)
        assert [runs.place(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_fill_in_middle(spark, tmp_path):
    """By plain Python, odd rows included; every output goes back to its text."""
    path = table(spark, tmp_path, ODD * 8)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    whole = middle.transform(docs)
    assert set(docs.columns) <= set(whole.columns)
    forms = set()
    for r in whole.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect():
        text, digest = r.text or "", sha(f"1:{'' if r.doc_id is None else r.doc_id}")
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        prefix, mid, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{mid}", "spm": f"<S>{suffix}<P>{prefix}<M>{mid}"}[form]
        assert (r.n, r.form, r.output, r.back) == (len(units), form, output, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(prefix), len(mid)))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"} and middle.transform(docs.where("false")).count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    made = queries_free.op12_fill_in_middle(spark, path)
    by_sql = con.sql(f"SELECT {', '.join(made.columns)} FROM ({registry.ORACLE_SQL['op12_fill_in_middle']})").fetchall()
    assert sorted(map(str, by_sql)) == sorted(str(tuple(r)) for r in made.collect())


def all_runs(words, least=6, times=4):
    """Stretches where words q apart are equal, for every q, without those of a smaller period."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            w = words[s : i + q]
            if len(w) >= max(least, times * q) and all(any(x != y for x, y in zip(w, w[d:])) for d in range(1, q)):
                out.append((s, len(w), q))
    return sorted(out)


def test_runs_against_all_periods():
    rng, texts = random.Random(1), []
    for _ in range(900):
        n, letters = rng.randrange(50), rng.choice([1, 2, 2, 3, 5, 20])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 4))
            words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
        texts.append(words + words[::-1] + words if rng.random() < 0.3 else words)
    for least, times in ((6, 4), (2, 2), (3, 3)):
        assert repeats.runs_of(texts, least, times) == [all_runs(t, least, times) for t in texts]
        assert [repeats.runs_of([t], least, times)[0] for t in texts[:200]] == [all_runs(t, least, times) for t in texts[:200]]


def test_periodic_runs_query(spark, tmp_path):
    """The whole query by plain Python over sf0.01 and over odd rows."""
    path = table(spark, tmp_path, [*ODD, "a b " * 9 + "c", "x " * 7, "a b c d " * 3 + "e", "q " * 6 + "a b " * 4 + "r"])
    seen = 0
    for place in (MID, path):
        texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()]
        want = []
        for key, text in texts:
            words, runs = (text or "").encode().split(), []
            h = 1 if key is None else zlib.crc32(str(key).encode())
            if h % 10 == 0 and words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            if len(words) < 1500:
                runs = all_runs(words)
            else:
                runs = repeats.runs_of([words])[0]
            best = min(((-n, s, q) for s, n, q in runs), default=None)
            drop = {i for s, n, q in runs for i in range(s + q, s + n)}
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            kept = b" ".join(w for i, w in enumerate(words) if i not in drop).decode()
            want.append((key, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4), sha(lines), sha(kept)))
            seen += len(runs)
        got = [tuple(r) for r in queries_free.op13_periodic_runs(spark, place).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert seen > 50
    docs = frame(spark, ODD)
    found = repeats.with_runs(docs)
    assert set(docs.columns) <= set(found.columns) and repeats.with_runs(docs.where("false")).count() == 0
