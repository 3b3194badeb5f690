"""Source divergence, URL filters and collocations on small tables, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
import zstandard
from pyspark.sql import functions as F

from strandlog.llm import collocations, divergence, secret_scan, url_filter

UPPER = str.maketrans(divergence.UPPER, divergence.LOWER)


def groups(docs):
    """Documents in languages and sources, with a column of each clashing name."""
    return docs.withColumns({"lang": F.when(F.col("doc_id") % 5 > 0, F.element_at(F.array(F.lit("en"), F.lit("de")), (F.col("doc_id") % 2 + 1).cast("int"))), "source": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 4)), "term": F.lit("t"), "n": F.lit(2), "phrase": F.lit("p"), "value": F.lit(None).cast("int")})


# 11 source divergence


def audited(rows, least, top):
    terms, seen, known = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(divergence.TERM, (text or "").translate(UPPER))
        terms[lang, source].update(found)
        seen[lang].update(set(found))
        known[lang].add(source)
    out = set()
    for lang, sources in known.items():
        kept = [t for t, d in seen[lang].items() if d >= least]
        size = {s: sum(terms[lang, s][t] for t in kept) for s in sources}
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        p = {s: {t: share(terms[lang, s][t], size[s]) for t in kept} for s in sources}
        q = {t: share(sum(terms[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            above = [(q[t] - p[s][t], t.encode()) for t in kept if terms[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, part, item.decode(), -v, k) for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:top])) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least,top", [(1, 3), (2, 50), (1000, 5)])
def test_divergence_equals_brute_force(docs, least, top):
    docs = groups(docs)
    want = audited([(r["text"], r["lang"], r["source"]) for r in docs.select("text", "lang", "source").collect()], least, top)
    got = divergence.audit(docs, least, top).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_divergence_of_counts_that_pass_64_bits(spark):
    kept = spark.createDataFrame([("x", "a", [("s", 10**13), ("t", 1)]), ("x", "b", [("s", 3)])], "lang string, term string, cells array<struct<source:string,n:long>>")
    langs = spark.createDataFrame([("x", ["s", "t"], [10**13 + 3, 1], 10**13 + 4, 2)], "lang string, sources array<string>, sums array<long>, total long, v long")
    got = {r["term"]: (list(r["shares"]), r["q"]) for r in divergence.vectors(kept, langs).collect()}
    share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 10)
    assert got == {"a": ([share(10**13, 10**13 + 3), share(1, 1)], share(10**13 + 1, 10**13 + 4)), "b": ([share(3, 10**13 + 3), share(0, 1)], share(3, 10**13 + 4))}


def test_divergence_without_rows(nothing):
    assert divergence.audit(groups(nothing)).count() == 0


# 12 URL filters

HOSTS = ["net", "a.net", "b.a.net", "xnet", "A.NET", "a..net", ".net", "a.net.", "", "com", "x.com:80", "user@a.net"]
PATHS = ["", "/", "/en", "/en/", "/en/x", "/en//x/y", "/de/x?q=/en/", "?/en/", "#a", "/é/日本/x", "//"]
LISTED = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en", "block"), ("a.net", "", "allow"), ("b.a.net", "/en//x", "block"), ("com", "/é/日本/", "block"), ("COM", "/", "allow"), ("", "/", "block"), ("a.net", "/en/", "block"), (None, "/", "block"), ("net", None, "allow")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules, otherwise):
    host, path = split_url(url)
    fits = [(len(h) + len(p), len(h), h, v == "block", p, v) for h, p, v in ((h.translate(UPPER), p, v) for h, p, v in rules if h is not None and p is not None) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[4], best[5] if best else otherwise


@pytest.mark.parametrize("rules,otherwise", [(LISTED, "allow"), (LISTED[:1], "allow"), ([("net", "", "block")], "allow"), ([], "block"), (url_filter.RULES, "allow"), ([("a.net", "/en/x", "block"), ("net", "/en/", "allow")], "block")])
def test_urls_equal_brute_force(spark, rules, otherwise):
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in HOSTS for p in PATHS]
    urls += [None, "", "a.net/en/", "http://", "mailto:x", "http:// a.net/\n", "http://a.net/en/\n?", "x://y://a.net/en/", "http://a.net/", "http://" + "a." * 20_000 + "net/" + "en/" * 20_000, "http://a.net/en/" + "x" * 300_000]
    pages = spark.createDataFrame([(k % 9, u, "kept", "gone", "mine") for k, u in enumerate(urls)], "page_id long, url string, row string, host string, site_path string").repartition(3)
    got = url_filter.judged(pages, url_filter.rule_table(spark, rules), otherwise)
    assert got.columns == ["page_id", "url", "row", "site_path", "host", "path", "rule", "verdict"]
    want = Counter((k % 9, u, "kept", "mine", *judged(u, rules, otherwise)) for k, u in enumerate(urls))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_urls_without_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none, url_filter.rule_table(spark, LISTED)).count() == 0


# 13 collocations


def ranked(rows, least, top, share):
    count, total, out = defaultdict(Counter), Counter(), set()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                count[lang].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    for lang, f in count.items():
        some = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        found = []
        for w, a in some.items():
            if any(100 * b >= share * a for x, b in some.items() if len(x) > len(w) and w in (x[:2], x[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out |= {(lang, k, p.decode(), -a, x, y, total[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("least,top,share", [(2, 40, 50), (1, 5, 100), (3, 2000, 30)])
def test_collocations_equal_brute_force(docs, least, top, share):
    docs = groups(docs)
    want = ranked([(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()], least, top, share)
    got = collocations.collocations(docs, least, top, share, block=1000, cells=1 << 10).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block,cells", [(1 << 21, 1 << 22), (5000, 1 << 8)])
def test_collocations_of_random_words(spark, block, cells):
    words = random.Random(5)
    texts = [" ".join(f"w{int(words.paretovariate(0.3)) % 5000}" + words.choice(["", "", "", ".", "\t", "  x"]) for _ in range(4000)) for _ in range(12)]
    docs = spark.createDataFrame([(t, "en" if k else None) for k, t in enumerate(texts)], "text string, lang string").repartition(4)
    got = collocations.collocations(docs, 4, 300, 50, block, cells).collect()
    assert {tuple(r) for r in got} == ranked([(t, "en" if k else None) for k, t in enumerate(texts)], 4, 300, 50)


def test_blocks_hold_every_phrase_once():
    hashes = collocations.Hashes(step=64)
    for data in (b"a b c\n\nd e f g  \nh", b"one two three four five six seven" * 9, b"x" * 300 + b" y z", b" \n ", b""):
        data = re.sub(rb"  +", b" ", data)
        for most in (4, 7, 50, 1000):
            got = Counter(b[s:e] for b, own in collocations.blocks(data, most) for _, _, starts, ends, _ in collocations.phrases(hashes, "en", b, own) for s, e in zip(starts, ends))
            want = Counter(b" ".join(w[k : k + n]) for line in data.split(b"\n") for w in [line.split()] for n in (1, 2, 3) for k in range(len(w) - n + 1))
            assert got == want


def test_hashes_of_ranges_do_not_depend_on_their_place():
    hashes, word = collocations.Hashes(step=32), b"some words here"
    found = {int(h[0]) for pad in (0, 1, 31, 32, 33, 200) for n, at, _, _, h in collocations.phrases(hashes, "en", b"\n" * pad + word, pad + 1) if n == 3}
    other = {int(h[0]) for n, at, _, _, h in collocations.phrases(hashes, "de", word, 1) if n == 3}
    assert len(found) == 1 and found.isdisjoint(other)


def test_answers_never_miss_a_frequent_phrase():
    import pyarrow as pa

    width = 1 << 12
    texts = pa.RecordBatch.from_pydict({"block": [0, 1], "lang": ["en"] * 2, "own": [11, 11], "data": [zstandard.ZstdCompressor().compress(t) for t in (b"a b c a b c", b"a b\na b c z")]})
    sketches = pa.Table.from_batches(list(collocations.sketched(3, width, 1 << 8)(iter([texts]))))
    answers = [collocations.merged(3, 1 << 8)(sketches.filter(pa.compute.equal(sketches["slice"], s))) for s in sorted(set(sketches["slice"].to_pylist()))]
    answers = pa.concat_tables(answers)
    for k, want in enumerate([{"": 6, "a": 2, "b": 2, "c": 2, "a b": 2, "b c": 2, "a b c": 2}, {"": 6, "a": 2, "b": 2, "c": 1, "a b": 2, "b c": 1, "a b c": 1}]):
        got = collocations.counted(width, 1 << 8)(pa.Table.from_batches([texts.slice(k, 1)]), answers.filter(pa.compute.equal(answers["block"], k)))
        assert dict(zip(got["phrase"].to_pylist(), got["n"].to_pylist())).items() >= want.items()


def test_packed_cells_come_back():
    cells = np.array([0, 1, 7, 70_000, 4_000_000])
    at, n = collocations.unpacked(collocations.packed(cells, np.array([1, 2, 3, 10, 127])))
    assert at.tolist() == cells.tolist() and n.tolist() == [1, 2, 3, 10, 127]


def test_collocations_without_rows(nothing):
    assert collocations.collocations(groups(nothing)).count() == 0


# 8 secret scans: rules on texts made to be slow


HARD = {
    "assign": ["password ", "password  =", "token=" + "a", "api_key' ", "secret:" + " " * 50],
    "access": ["AKIA", "AKIAA ", "AKI"],
    "hex": ["0123456789abcdef0123456", "a" * 23 + "g", "f"],
    "pem": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN ", "-----BEGIN A PRIVATE KEY-----\n" + "A" * 15 + "\n", "-----BEGIN PRIVATE KEY-----\n" + "A" * 64 + "\n", "-----END ", "PRIVATE KEY", "-----BEGIN PRIVATE KEY-----" + "\\n" * 9],
    "vcs": ["ghp_", "ghp_" + "a" * 35 + "_", "gh"],
    "chat": ["xoxa-", "xoxa-aaaaaaaaa ", "xox"],
    "jwt": ["eyJ", "eyJaaaaaaaa.", "eyJaaaaaaaa.aaaaaaaa.a.", "eyJaaaaaaaa.eyJ.", "-"],
    "cloud": ["AIza", "AIza" + "a" * 34 + " ", "A"],
}


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_rules_take_a_megabyte_of_any_kind_in_little_time(rule):
    import time

    compiled = rule.compiled()
    for unit in HARD[rule.kind]:
        text = "" + unit * (1_000_000 // len(unit))
        for x in (text, text + " end", "-----BEGIN PRIVATE KEY-----\n" + text, "eyJ" + text):
            began = time.process_time()
            rule.spans(x, compiled)
            assert time.process_time() - began < 3, unit


def test_jwt_spans_are_those_of_the_plain_expression():
    rule = next(r for r in secret_scan.RULES if r.kind == "jwt")
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    dice = random.Random(3)
    units = ["eyJ", "a" * 8, "b" * 7, ".", ".", "-", " ", "ey", "J_x", "é"]
    for _ in range(5000):
        text = "".join(dice.choice(units) for _ in range(dice.randint(1, 24)))
        assert rule.spans(text, rule.compiled()) == [m.span() for m in plain.finditer(text)], text
