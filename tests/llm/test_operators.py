"""Training-data operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.llm import anchors, common, decontaminate, html_extract, jaccard_join, packing, quality, substring_dedup, suffix_dedup, suffix_tree_lm, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, repeats string, n_words long, rep string, row long, n int, place int"
ITEMS = [(1, "the blue heron waits beside seven narrow canals and never asks why. Because fish come home."), (2, None), (3, ""), (4, "short question only")]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["é", "straße", "日本", "don't", "a|b", "#x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = text(60), text(25)
    docs = {i: text(rng.randint(30, 120)) for i in range(20)}
    docs |= {20: docs[3], 21: docs[3], 22: docs[4] + " tail", 23: text(5) + " " + shared + " " + text(7), 24: shared, 25: text(40) + "\n" + line + "\t" + text(30), 26: line, 27: line + " " + line}
    docs |= {28: None, 29: "", 30: "  \n\t ", 31: "one two three", 32: "same " * 300, 33: text(6000), 34: ITEMS[0][1], 35: text(80) + " " + ITEMS[0][1] + " " + text(80), 36: "a\x0bb\x0cc d e", 37: docs[5].replace("w1", "v1", 1)}
    return docs


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "a")[i % 2], len(t or ""), 7, "k", "r", 1, "p", 2, 3, 4) for i, t in DOCS.items()]
    rows += [rows[3], (None, "null id " + DOCS[0], "en", "a", 3, 7, "k", "r", 1, "p", 2, 3, 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot,filtered", [(4096, anchors.FILTERED), (1, anchors.FILTERED), (4, 0)])
def test_substring_dedup(docs, none, hot, filtered, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "FILTERED", filtered)
    seen, expected = set(), {}
    for i, t in sorted(DOCS.items()):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone |= set(range(s, s + 20))
            seen.add(k)
        expected[i] = (len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone))
    got = substring_dedup.remove_repeats(docs, out_col="found").select("doc_id", "found.n_words", "found.n_removed", "found.kept").collect()
    assert len(got) == len(DOCS) + 2
    for r in got:
        if r[0] is None:
            assert r[2] == 0
        else:
            assert tuple(r)[1:] == expected[r[0]], r[0]
    assert substring_dedup.remove_repeats(none, out_col="found").count() == 0


def test_match_reference(docs):
    out = {r[0]: r[1] for r in substring_dedup.match_reference(docs, [DOCS[24], DOCS[0]], out_col="found").select("doc_id", "found.n_removed").collect()}
    assert out[24] == 60 and out[23] >= 60 and out[0] == len(DOCS[0].split()) and out[1] == 0
    with pytest.raises(ValueError):
        substring_dedup.match_reference(docs, ["a " * 300_000])


@pytest.mark.parametrize("hot,filtered", [(4096, anchors.FILTERED), (1, anchors.FILTERED), (4, 0)])
def test_suffix_dedup(docs, none, hot, filtered, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "FILTERED", filtered)
    length, n = 100, Counter()
    for t in DOCS.values():
        b = (t or "").encode()
        n.update(b[s : s + length] for s in range(len(b) - length + 1))
    near, where = 60, Counter()
    for i, t in DOCS.items():
        b = (t or "").encode()
        for s in range(len(b) - near + 1):
            where[b[s : s + near]] += 1
    for report in (None, near):
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_strings(docs, length, out_col="found", report=report).select("doc_id", "found.n_bytes", "found.n_removed", F.size("found.spans"), "found.kept", "found.n_shared").collect()}
        for i, t in DOCS.items():
            b = (t or "").encode()
            both = np.zeros(len(b), bool)
            for s in range(len(b) - near + 1):
                if where[b[s : s + near]] > 1:
                    both[s : s + near] = True
            assert got[i][4] == (int(both.sum()) if report else None), i
    got = {i: v[:4] for i, v in got.items()}
    for i, t in DOCS.items():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((gone[:-1] & ~gone[1:]).sum())
        assert got[i] == (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)), i
    assert suffix_dedup.remove_strings(none, out_col="found").count() == 0


def repeats_of(texts, length):
    n = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    return [len(t) - length >= s and n[t[s : s + length]] > 1 for t in texts for s in range(len(t))]


def test_one_order_gives_repeats_of_two_lengths():
    rng = random.Random(2)
    for _ in range(300):
        long = rng.choice([9, 12, 20, 40, 100])
        short = rng.randint(4, long)
        letters = rng.choice([b"a", b"ab", b"abcdefgh", bytes(range(256))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(4)]
        texts = [b"".join(rng.choice(base)[: rng.randint(1, 150)] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        starts = np.array([len(t) for t in texts])
        got = suffix_dedup.Parse(texts, long).repeats((long, short), starts)
        assert [x.tolist() for x in got] == [repeats_of(texts, long), repeats_of(texts, short)]


def test_parse_finds_all_repeats():
    rng = random.Random(1)
    for _ in range(400):
        length = rng.choice([5, 9, 12, 20, 40, 100])
        letters = rng.choice([b"a", b"ab", b"abcdefgh", bytes(range(256))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(3)]
        texts = [b"".join(rng.choice(base)[rng.randint(0, 60) : rng.randint(20, 150)] for _ in range(rng.randint(1, 4))) or b"x" for _ in range(rng.randint(1, 8))]
        texts = list(dict.fromkeys(texts))
        starts = np.array([len(t) for t in texts])
        assert suffix_dedup.Parse(texts, length + rng.choice((0, 30))).repeated(length, starts).tolist() == repeats_of(texts, length)


def brute_classes(least=0.8):
    first, sets = {}, {}
    for i, t in sorted(DOCS.items()):
        first.setdefault(t or "", i)
    for t, i in first.items():
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    links, parent = defaultdict(set), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(first[t or ""]), len(links[first[t or ""]])) for i, t in DOCS.items()}


@pytest.mark.parametrize("leaf,block", [(200, 500), (1, 1)])
def test_near_duplicates(docs, none, leaf, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(DOCS) + 2
    expected = brute_classes()
    assert any(n for _, n in expected.values())
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None and r.n_links == 0
        else:
            assert (r.class_id, r.n_links) == expected[r.doc_id], r
    if leaf > 1:
        assert jaccard_join.near_duplicates(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(34, 1), (35, 1)}
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, items).select("doc_id").collect()}
    assert kept == (set(DOCS) | {None}) - {34, 35}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_encoder_has_the_ids_of_the_library():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    rng = random.Random(3)
    letters = "aAbTIKwyhj .,!?*'0123é\u0331\u0308\u0307\u030aßİſK中가\u1100\u1161\u00a0\u2028\n\t#&$|İΣς½ªǅ"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [x or "" for x in DOCS.values()]
    got = list(own.encode([o.encode() for o in odd]))
    for o, ids in zip(odd, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(o, add_special_tokens=False).ids, ascii(o)


def test_components_take_one_query_a_round(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 112)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200, j) for j in range(201, 230)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    written, links = [], [spark.createDataFrame(p, "a long, b long") for p in (pairs, [(7, j) for j in range(8, 12)], [(5, 5)])]
    real = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(type(links[0]), "first", lambda self: pytest.fail("a query beside the round's own"))
    every, star, none = map(jaccard_join.components, links)
    in_all = len(written)
    assert {tuple(r) for r in every.collect()} == {(x, c) for x, c in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert sorted(map(tuple, star.collect())) == [(j, 7) for j in range(7, 12)] and none.count() == 0
    written.clear()
    jaccard_join.components(links[1])
    assert len(written) == 2 and in_all < 16  # the edges, and the one round that changes nothing


def test_encoder_learns_letters_once_whatever_signs_follow(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens.Encoder, "STRETCH", 3, raising=False)
    t, own = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    texts = ["quuxle quuxle. quuxle!! \u00e9t\u00e9, \u00c9t\u00e9, ...", "", " \t\x0b", "quuxle# don't quuxle", "\u00e9t\u00e9&&"]
    for x, ids in zip(texts, own.encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert b"quuxle" in own.known and "\u00e9t\u00e9".encode() in own.known
    assert not {b"quuxle.", b"quuxle!!", b"quuxle#"} & own.known.keys()


def test_wand_finds_all():
    rng = random.Random(2)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(3, 30)))) for i in range(80)]
    index = decontaminate.Index(items)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 30)))
        scores = defaultdict(float)
        for t in terms:
            for i, w in index.postings[t]:
                scores[i] += w
        for least in (0.1, 0.3, 0.6):
            expected = {i for i, s in scores.items() if s >= least + 1e-9}
            assert expected <= {i for i, _ in index.search(terms, least)}
            one = index.candidates(np.zeros(len(terms), np.int64), np.array(terms), least)
            assert not expected or len(one) == 1


def test_tokens_and_packing(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in DOCS.items()}
    path = f"file://{tmp_path}/tokens"
    tokens.write_tokens(docs, path, tokens.default_tokenizer())
    got = sorted(tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids").collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted([i for i in DOCS] + [3, None], key=lambda x: (x is not None, x))
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.doc_id is None or r.ids == [*ids[r.doc_id], 2]
        at += r.n_tokens
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)  # several files a task
    try:
        tokens.write_tokens(docs, f"{path}-split", tokens.default_tokenizer())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    split = sorted(tokens.read_tokens(spark, f"{path}-split").select("doc_id", "start", "n_tokens", "ids").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in split] == [(r.doc_id, r.start, r.n_tokens) for r in got]
    import pyarrow.parquet as pq

    foot = pq.ParquetFile(next(p for p in sorted(tmp_path.glob("tokens/part-*.parquet")) if pq.read_metadata(p).num_rows)).metadata.row_group(0)
    by = {foot.column(i).path_in_schema: foot.column(i) for i in range(foot.num_columns)}
    assert by["doc_id"].has_column_index and by["doc_id"].has_offset_index
    assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings) and any("DELTA" in e for e in by["doc_id"].encodings + by["task_start"].encodings)
    plan = tokens.read_tokens(spark, path).where("doc_id = 5").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("ReadSchema")[1:] if "doc_id" in x)
    assert "ids" not in scan.split("\n")[0] and "EqualTo(doc_id,5)" in plan
    assert tokens.read_tokens(spark, path).where("doc_id = 5").count() == 1
    packed = packing.pack(packing.pieces(docs, tokens.default_tokenizer(), 512, 0, "doc_id", "text"), 512).collect()
    seqs = defaultdict(list)
    for r in packed:
        seqs[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            part = [*ids[r.doc_id], 0][r.start : r.start + 512]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(packing.pieces(none, tokens.default_tokenizer(), 512, 0, "doc_id", "text"), 512).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 300))]
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [i for i, left in enumerate(bins) if left >= x]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= x
            else:
                bins.append(64 - x)
        runs, n = packing.plan(Counter(lengths), 64)
        assert n == len(bins)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<html><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>four</article><footer>f</footer>"), (4, "u", "<div class='comments'><p>" + "nice " * 40 + "</p></div>"), (5, "u", "<script>var a='</p>'</script><!-- x -->")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {1: "", 2: "", 3: "A & B\none two three\nfour", 4: "", 5: ""}
    tree = html_extract.grow(html_extract.labelled_rows())
    assert all(html_extract.classify(tree, tuple(r[:-1])) == r[-1] for r in html_extract.labelled_rows())


def test_warc(spark, tmp_path, monkeypatch):
    long, tricky = "x" * 200, "<p>WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n</p>" + "é" * 60
    rows = [(5, "u5", long), (2, "u2", long), (9, None, long), (1, "u1", "short"), (3, "u3", "short"), (4, "u4", None), (6, "u6", tricky), (7, "u7", tricky), (2, "u2", long), (None, "u", long)]
    pages = spark.createDataFrame(rows, "id long, uri string, payload string")
    for k, limit in enumerate((100_000, 0)):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
        path = f"file://{tmp_path}/warc{k}"
        warc.write_archives(pages, path)
        got = warc.resolved(warc.read_archives(spark, path)).collect()
        assert len(got) == len(rows)
        by = {r.id: r for r in got}
        for i, _, p in rows:
            b = (p or "").encode()
            assert (by[i].payload_bytes, by[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
            assert by[i].record_type == ("revisit" if i in (5, 9, 7) else "response")
            assert by[i].refers_to == {5: 2, 9: 2, 7: 6}.get(i)
            assert i in (5, 9, 7) or bytes(by[i].payload) == b
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/empty")
    assert warc.resolved(warc.read_archives(spark, f"file://{tmp_path}/empty")).count() == 0
    uneven = spark.createDataFrame([(i, None, chr(97 + i) * n) for i, n in enumerate((10, 100_000, 3_000_000, 50))], "id long, uri string, payload string")
    warc.write_archives(uneven, f"file://{tmp_path}/uneven")
    assert sorted((r.id, r.payload_bytes) for r in warc.read_archives(spark, f"file://{tmp_path}/uneven").collect()) == [(0, 10), (1, 100_000), (2, 3_000_000), (3, 50)]


def test_quality(docs, none):
    rows = quality.statistics(docs).select("doc_id", quality.group_key("lang", "source").alias("g"), "stats.*")
    for r in rows.collect():
        if r.doc_id is None:
            continue
        t = DOCS[r.doc_id] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    kept = {r.doc_id for r in quality.kept_documents(docs).collect()}
    assert 32 not in kept and 31 not in kept and set(range(20)) <= kept
    assert quality.kept_documents(docs).columns == docs.columns
    assert quality.kept_documents(none).count() == 0


def test_mahalanobis_distance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality.DIMS)) * [0.3, 0.2, 0.4, 0.5, 0.3]
    x[:20] += 6
    rows = spark.createDataFrame([(i, "g", False, *map(float, v)) for i, v in enumerate(x)], "i long, g string, base_failed boolean, x0 double, x1 double, x2 double, x3 double, x4 double")
    fitted = quality.moments(rows.where("i >= 20"), "g")
    got = np.array([r.d2 for r in quality.with_distance(rows, fitted, "g").orderBy("i").collect()])
    c = np.cov(x[20:].T, bias=True) + np.diag(np.square(quality.FLOORS))
    d = x - x[20:].mean(axis=0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    kept = {r.i for r in quality.verdict(rows, quality.fit(rows)).where("kept").collect()}
    assert kept == set(range(20, 400))


def brute_mcd(x):
    """Squared distances by the minimum covariance determinant search, scaled, of one group in numpy."""
    n, floors, at = len(x), np.array(quality.FLOORS), lambda v, share: np.sort(v)[max(0, math.ceil(share * len(v)) - 1)]

    def estimate(own):
        c = own.T @ own / len(own) - np.outer(own.mean(0), own.mean(0))
        low = np.zeros((quality.DIMS, quality.DIMS))
        for i in range(quality.DIMS):
            for j in range(i + 1):
                v = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, 0) + floors[i] ** 2) if i == j else v / low[j, j]
        return own.mean(0), low, 2 * np.log(np.diag(low)).sum()

    def distance(e):
        y = np.linalg.solve(e[1], (x - e[0]).T)
        return (y * y).sum(0)

    step = lambda d: estimate(x[d <= at(d, quality.SHARE)])
    middle = np.array([at(c, 0.5) for c in x.T])
    z2 = ((x - middle) / (1.4826 * np.array([at(c, 0.5) for c in abs(x - middle).T]) + floors)) ** 2
    tried = [step(d) for d in (z2.sum(1), z2.max(1), distance(estimate(x)))]
    for _ in range(quality.FIRST):
        tried = [step(distance(e)) for e in tried]
    best = min(tried, key=lambda e: e[2])
    while (new := step(distance(best)))[2] < best[2] - quality.FALL:
        best = new
    d = distance(best)
    assert n > 0
    return d / max(1.0, at(d, 0.5) / quality.CHI2_MEDIAN), best[2]


def test_minimum_covariance_determinant(spark):
    rng = np.random.default_rng(9)
    groups = {}
    for g, n, bad in (("a", 300, 60), ("b", 120, 25), ("c", 40, 8), ("one", 1, 0), ("flat", 30, 0)):
        x = rng.normal(size=(n, quality.DIMS)) @ rng.normal(size=(quality.DIMS, quality.DIMS)) * 0.4
        x[:bad] += rng.normal(size=quality.DIMS) * 9
        groups[g] = x if g != "flat" else np.ones_like(x)
    rows = [(f"{g}{i}", g, False, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i string, g string, base_failed boolean, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(3)
    fitted = quality.fit(df)
    got = {r.i: r for r in quality.verdict(df, fitted).collect()}
    dets = {r.g: r.log_det for r in fitted.collect()}
    for g, x in groups.items():
        d, det = brute_mcd(x)
        assert math.isclose(dets[g], det, abs_tol=1e-6)
        for i, v in enumerate(d):
            assert math.isclose(got[f"{g}{i}"].distance, v, rel_tol=1e-6, abs_tol=1e-6)
            assert got[f"{g}{i}"].kept == (v <= quality.CUTOFF)
    assert not got["a0"].kept and got["a299"].kept and got["one0"].kept and got["flat3"].kept


@pytest.mark.parametrize("listed", [2_000_000, 150])
def test_language_model(docs, none, listed, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "MAX_LISTED", listed)
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", 2)
    monkeypatch.setattr(suffix_tree_lm, "MIN_CONTEXT", 2)
    monkeypatch.setattr(suffix_tree_lm, "WORD_PRICE", 0.5)
    monkeypatch.setattr(suffix_tree_lm, "STATE_PRICE", 0.5)
    got = suffix_tree_lm.score(docs).collect()
    assert len(got) == len(DOCS) + 2
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    rows = [*DOCS.items(), (3, DOCS[3]), (None, "null id " + DOCS[0])]
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), b" "])
    total, distinct = sum(c.values()), len(c)
    for r in got:
        w = [*(dict(rows)[r.doc_id] or "").encode().lower().split(), b" "]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    test_language_model.scores = getattr(test_language_model, "scores", {}) | {listed: sorted((r.doc_id or -1, round(r.score, 6)) for r in got)}
    if len(test_language_model.scores) == 2:
        assert len({tuple(v) for v in test_language_model.scores.values()}) == 1  # blocks don't change scores
    if listed > 150:
        assert suffix_tree_lm.score(none).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, own, str(tmp_path))
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            out.write.parquet(f"{tmp_path}/stage{k}")
            own = spark.read.parquet(f"{tmp_path}/stage{k}")
            ids = [r.doc_id for r in own.collect()]
            if k == 1:
                assert 20 not in ids and 21 not in ids and ids.count(3) == 1
            if k == 3:
                assert 34 not in ids and 35 not in ids
    assert {r.doc_id for r in out.collect()} == set(ids)


def test_pipeline_removes_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(1000)}" for _ in range(n)]
    over, fifty = text(51), text(50)
    assert len(" ".join(over)) < 400  # too short for strings of 400 bytes
    long = "x" * 500  # fewer words, but over 400 bytes
    given = [(text(9), text(9)) for _ in range(6)]
    rows = [[*a, *own, *b] for (a, b), own in zip(given, (over, over, fifty, fifty, [long], [long]), strict=True)]
    texts = ["  ".join(r) if i == 1 else " ".join(r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    for i in (0, 1):
        assert left[i].text.split() == [*given[i][0], *given[i][1]]
    assert [left[i].text for i in (2, 3)] == texts[2:4]
    assert long not in left[4].text and long not in left[5].text
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = " ".join(["changed", *b.split()[1:]])
    rows = [(1, a), (1, b), (1, b), (2, near), (3, c), (3, None), (3, ""), (4, c), (None, d), (None, d), (5, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()
    assert [x for x in left[0].asDict()] == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id, r.text or "") for r in left if r.doc_id is not None) == sorted([(1, a), (1, b), (3, c), (3, "")])
    assert sum(r.doc_id is None for r in left) == 2


@pytest.mark.parametrize("words", [1, 40, 300])
def test_scores_do_not_depend_on_blocks_of_items(spark, words, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(150)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{item(rng.randint(8, 40))}. {item(rng.randint(2, 12))}") for i in range(30)] + [(30, ""), (31, None), (None, "no id"), (32, "...")]
    changed = lambda t: " ".join(w if rng.random() > 0.03 else "other" for w in t.split())
    rows = [(i, f"{item(60)} {changed(items[i % 30][1])} {item(40)} {items[(7 * i) % 30][1]}") for i in range(60)] + [(90, None), (91, "")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = lambda: {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.contaminated(docs, benchmark).collect()}
    expected = found()
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", words)
    got = found()
    assert len(expected) >= 60 and got.keys() == expected.keys()
    assert all(np.allclose(got[k], v, rtol=1e-12) for k, v in expected.items())
    assert {r.doc_id for r in decontaminate.clean_documents(docs.limit(5), benchmark).collect()} == {r.doc_id for r in docs.limit(5).collect()} - {k[0] for k in expected}


def test_links_are_contracted_in_tasks_before_any_round(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300, 340)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(500, j) for j in range(480, 530)]
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    links = common.stored(spark.createDataFrame(pairs, "a long, b long"), "links")
    written, real = [], common.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(name) or real(df, name))
    assert dict(map(tuple, jaccard_join.classes_of(links).collect())) == label and len(written) == 1
    assert jaccard_join.classes_of(links.where("a = b")).count() == 0
    monkeypatch.setattr(jaccard_join, "PORTION", 7)
    got = jaccard_join.classes_of(links).collect()
    assert dict(map(tuple, got)) == label and len(got) == len(label)


def test_leaves_of_all_levels_are_compared_in_one_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    common_words = [f"c{i}" for i in range(12)]
    texts = [" ".join(common_words + [f"w{rng.randint(0, 400)}" for _ in range(8)]) for _ in range(120)]
    texts += [texts[0] + f" x{i}" for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [sum(a != b and len(x & y) >= 0.8 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    calls, real = [], jaccard_join.by_key
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "by_key", lambda rows, judge, *a, **k: calls.append(judge) or real(rows, judge, *a, **k))
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == links and max(links) >= 8
    assert 2 <= calls.count(jaccard_join.sketch_links) <= jaccard_join.LEVELS + 1


def test_suffixes_that_nobody_asks_for_take_no_memory():
    import tracemalloc

    text = np.random.default_rng(3).integers(97, 123, 300_000, np.uint8).tobytes()
    text += text[:500]
    parse = suffix_dedup.Parse([text], 400)
    tracemalloc.start()
    flags = parse.repeats((400, 256), np.array([50]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(text) and not any(f.any() for f in flags)
    every = parse.repeats((400, 256), np.array([len(text)]))
    for f, length in zip(every, (400, 256), strict=True):
        assert np.flatnonzero(f).tolist() == [*range(501 - length), *range(300_000, 300_501 - length)]


def frequent_passages(n, seed=4):
    """Texts with one passage, each with words of its own around it, and copies of the first of them."""
    rng = np.random.default_rng(seed)
    own = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    passage = own(320)
    texts = [own(300) + passage + own(300) for _ in range(n)]
    return texts + texts[:1] * n


def test_frequent_anchors_are_not_cut_into_windows(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", 5)
    texts = frequent_passages(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(2).select("id", F.col("text").cast("binary").alias("data"))
    rows = anchors.candidates(docs, suffix_dedup.byte_units, 256, 32, first_only=False, reach=400)
    sent = rows.where("data is not null").agg(F.sum(F.length("data")), F.count("*")).first()
    # each text has some three segments around its passage; cut into windows they were over 100 times as long
    assert sent[0] < 6 * sum(map(len, texts)) and sent[1] < 8 * len(texts)
    found = suffix_dedup.remove_strings(docs.select(F.col("id").alias("doc_id"), F.col("data").cast("string").alias("text")), out_col="found", report=256)
    got = {r[0]: (r[1], r[2]) for r in found.select("doc_id", "found.n_removed", "found.n_shared").collect()}
    where = Counter(t[s : s + 256] for t in texts for s in range(len(t) - 255))
    for i, t in enumerate(texts):
        shared = {p for s in range(len(t) - 255) if where[t[s : s + 256]] > 1 for p in range(s, s + 256)}
        assert got[i] == (len(t) if t == texts[0] else 0, len(shared)), i
    # the documents meet stored runs: text that went to the shards is on no disk by then
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("unit", [1, 4])
def test_large_shards_are_compared_window_by_window(unit, monkeypatch):
    texts = [t.encode() for t in frequent_passages(12)]
    rows = []
    for i, t in enumerate(texts):
        at = len(t) // 2 - 16  # one place of all passages
        first, last = at - 200, at
        rows.append((i, first // unit, last // unit, (at - first) // unit, t[first : last + 400 - i % 3 * 100 // unit * unit]))
    expected = sorted(suffix_dedup.shared_windows([rows], 400 // unit, 256 // unit, unit))
    monkeypatch.setattr(suffix_dedup, "LARGE", 0)
    assert sorted(suffix_dedup.shared_windows([rows], 400 // unit, 256 // unit, unit)) == expected and expected
