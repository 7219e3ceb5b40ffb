"""The near-dedup stage against exact similarities in plain Python, and every stage over odd rows."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tallyhouse.llm import jaccard
from tallyhouse.llm.common import Scratch
from tallyhouse.llm.simhash import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 5 else {tuple(ws)} if ws else set()


def groups(texts):
    """The least text number of each text's group, by all pairs: similarity of 0.8, or fingerprints within 2 bits."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    prints = [fingerprint(t, 5) for t in texts]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (prints[i] ^ prints[j]).bit_count() <= 2 or a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_near_dedup(spark):
    """Copies with up to three changed words of 120, texts under the bar, exact copies and blank texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [None, "", " ", "one two", "One two", "one three"]
    for n in range(40):
        ws = [word() for _ in range(120)]
        texts.append(" ".join(ws))
        for changes in (0, 1, 2, 3, 8):
            copy = list(ws)
            for at in rng.sample(range(5, 115), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    assert kept(spark, texts) == set(groups(texts))


def test_near_dedup_buckets(spark):
    """Chains, whose ends are unlike, and many texts about one passage: buckets hold more groups than there are leads."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(3):
        ws = [word() for _ in range(420)]
        texts += [" ".join(ws[at : at + 120]) for at in range(0, 300, 10)]
    passage = [word() for _ in range(140)]
    for own in (18, 20, 24, 30):
        for _ in range(20):
            ws = passage + [word() for _ in range(own)]
            texts.append(" ".join(ws))
            ws[rng.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    rng.shuffle(texts)
    assert kept(spark, texts) == set(groups(texts))


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


GOOD = [words(40, n) for n in range(6)]
#: Nulls in each column, repeated rows, empty, blank and very long texts.
ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t", None, "a", 3), (3, "few words", "en", None, 9),
    (4, GOOD[0], "en", "a", 1), (4, GOOD[0], "en", "a", 1), (None, GOOD[1], None, None, None), (5, GOOD[2] + "\nwrite to a.b@example.com now", "de", "b", 1), (6, words(30_000, 9), "de", "c", None),
    (7, "same " * 400, "en", "c", 2000), (8, GOOD[3] + " é漢字 " + GOOD[4], "fr", "b", 5), (4, GOOD[5], "en", "a", 1),
]


def odd(spark):
    """With columns whose names the stages use themselves."""
    clash = {c: F.lit(1) for c in ("size", "node", "_h", "_id", "spans", "kept", "grp", "x0", "text_key", "taken")}
    return spark.createDataFrame(ODD, DOCS).withColumns(clash)


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_quality_rules_over_odd_rows(spark):
    """Groups here are too small for an outlier test: what the base rules reject goes, in plain Python, and repeats stay."""

    def good(text):
        ws = (text or "").split()
        seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        again = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        return len(ws) >= 10 and 100 * len(again) <= 20 * len(ws)

    assert rows(corpus_pipeline.quality_rules(spark, odd(spark), "")) == Counter(r for r in ODD if good(r[1]))


def test_personal_data_over_odd_rows(spark):
    """Texts without personal data are as before, nulls included; an email becomes its kind."""
    got = rows(corpus_pipeline.personal_data(spark, odd(spark), ""))
    text = lambda t: t and t.replace("a.b@example.com", "<email>")
    assert Counter((i, t, la, s) for (i, t, la, s, _), n in got.items() for _ in range(n)) == Counter((i, text(t), la, s) for i, t, la, s, _ in ODD)
    assert all(n == (None if t is None else len(t)) for (_, t, _, _, n) in got)


def test_source_mixture_over_odd_rows(spark):
    """Each source's words come to its target, which is found in plain Python; no document is taken more than twice."""
    size = Counter()
    for _, t, _, s, _ in ODD:
        size[s] += len((t or "").split())
    order = [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else share[s]
            left -= target[s]
        open_ = open_ - full if full else set()
    got, each = Counter(), Counter()
    for (i, t, _, s, chars), n in rows(corpus_pipeline.source_mixture(spark, odd(spark), "")).items():
        assert chars == (None if t is None else len(t))
        got[s] += n * len((t or "").split())
        each[i, s] += n * len((t or "").split())
    assert all(abs(got[s] - target[s]) <= 1 for s in order)
    own = Counter()
    for i, t, _, s, _ in ODD:
        own[i, s] += len((t or "").split())
    assert all(n <= 2 * own[k] for k, n in each.items())


def test_vector_packing_over_odd_rows(spark):
    """Every id lies in one piece, a null or empty text is one id, and sequences have no gap and at most 4,096 ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = corpus_pipeline.vector_packing(spark, odd(spark), "").collect()
    want = Counter((i, len(own.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ODD)
    whole, sequences = Counter(), {}
    for r in got:
        whole[r.doc_id, r.doc_tokens] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert whole == Counter({k: k[1] * n for k, n in want.items()})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_over_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0


def near_copies(n, edits):
    """Texts of 150 words with so many words changed each: all share most of their shingles, few pairs reach the bar."""
    rng = random.Random(11)
    ws, texts = words(150, 3).split(), []
    for _ in range(n):
        own = list(ws)
        for at in rng.sample(range(5, 145), edits):
            own[at] = "".join(rng.choices("abcdefghij", k=6))
        texts.append(" ".join(own))
    return texts


def met(spark, texts):
    found = [jaccard.shingles(t, 5) for t in texts]
    sets = spark.createDataFrame([(i, i, f.view("int64").tolist()) for i, f in enumerate(found)], "node long, c long, set array<long>")
    return Counter(tuple(sorted(r)) for r in jaccard.candidates(sets, Scratch(spark), 0.8).collect())


def test_candidates_among_near_copies(spark):
    """All pairs at the bar are among them, and few others, however many texts are just under it; each comes once."""
    texts = near_copies(150, 2) + near_copies(5, 1) + ["", "one two", *near_copies(4, 0)]
    sets = [shingles(t) for t in texts]
    pairs = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if b and len(a & b) >= 0.8 * len(a | b)}
    got = met(spark, texts)
    assert len(pairs) > 100 and pairs <= set(got) and len(got) <= 1.5 * len(pairs) and set(got.values()) == {1}


def test_a_frequent_shingle_is_dealt(spark, monkeypatch):
    texts = near_copies(60, 2)
    whole = met(spark, texts)
    monkeypatch.setattr(jaccard, "SHARE", 7)
    assert whole and met(spark, texts) == whole
