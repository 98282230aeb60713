"""The ten operators against brute force and on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sonospan.llm import best_fit_packing, budget_mix, components, deep_shallow, html_text, jaccard_join, license_scan, line_dedup, pretokens, quality_rules, rule_stats, shingles, suffix_dedup, token_counts, vector_topk, wordhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, n string, id int, t string, h double"
WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omikron pi".split()


def words(r, n, spread=1000):
    return " ".join(r.choice(WORDS) + str(r.randrange(spread)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared passages, nulls, empty, blank, short and long texts, repeated rows."""
    r = random.Random(3)
    passage = words(r, 60)
    texts = [None, "", "  \n\t ", "one", "one two", "x" * 5000]
    base = [words(r, 120) for _ in range(12)]
    texts += base + base[:4] + base[:2]
    for b in base[4:9]:
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        texts.append(b + " tail " + words(r, 3))
    texts += [words(r, 30) + "\n" + passage + "\n" + words(r, 20) for _ in range(9)]
    line = words(r, 14)
    texts += [words(r, 12) + "\n" + " ".join(line.split()[:k] + ["new" + str(k)] + line.split()[k + 1 :]) + "\nshort line\n" + line for k in range(4)]
    texts += [words(r, 4000), "ab " * 3000, "é" * 700 + " " + "é" * 700, "a <|endoftext|> b\x1c😀 ΣΑΣ", "spam*** eggs### &&& $$$ %%% " * 12, "\n".join(["the same line again here"] * 9)]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], 0, "x", 1, "t", 1.0) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# 5 and 9: tokenizers


def test_token_counts_equal_the_library(docs, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in corpus)
    assert Counter(map(tuple, token_counts.token_counts(docs, path).collect())) == want


def test_token_counts_with_a_small_table_and_cache(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    few = token_counts.token_counts(docs, path, frequent=10).select("doc_id", "n_tokens").collect()
    assert sorted(few) == sorted(token_counts.token_counts(docs, path).select("doc_id", "n_tokens").collect())
    tiers = pretokens.TwoTier({"a": 1}, len, room=1)
    assert [tiers[x] for x in ("a", "bb", "cc", "ddd", "a")] == [1, 2, 2, 3, 1]


def test_very_long_texts_with_characters_left_to_the_library_are_cut(monkeypatch):
    monkeypatch.setattr(pretokens.pieces, "__defaults__", (40,))
    r = random.Random(9)
    text = " ".join(r.choice(["wörd", "\U0001f600", "a\U0001f600b", "é\u0301", "Ω's", "  ", "\n", "x1"]) for _ in range(400))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counter(path, {})(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert best_fit_packing.token_packer(path)(text) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_token_counts_of_no_rows(none):
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("alphabet", ["ab é\n\t  \x1c\x85　'sΣİ1²़😀<|endoftext|>̈́Ǆ", "ab éÉ\n\t  's're've'12 .,-"])
def test_pretokens_of_random_texts(alphabet):
    r = random.Random(1)
    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    count, pack = token_counts.token_counter(a, token_counts.frequent_lengths(a)), best_fit_packing.token_packer(b)
    for _ in range(300):
        s = "".join(r.choices(alphabet, k=40))
        assert count(s) == len(Tokenizer.encode(pretokens.tokenizer(a), s, add_special_tokens=False).ids)
        assert pack(s) == np.array(pretokens.tokenizer(b).encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_long_texts_are_cut_where_no_pretoken_is():
    text = "word1, другой  gap\n" * 400
    assert "".join(pretokens.pieces(text, 50)) == text
    assert [x for p in pretokens.pieces(text, 50) for x in pretokens.BYTE_PATTERN.findall(p)] == pretokens.BYTE_PATTERN.findall(text)


def test_packing_is_a_partition_into_full_sequences(docs, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = best_fit_packing.pack(docs, path, capacity=64).collect()
    want = Counter()
    for d, t, *_ in corpus:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], dtype="<u4")
            want[(d, k // 64, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    counts = Counter(r.length for r in got)
    assert best_fit_packing.lower_bound(counts, 64) <= len(sequences) <= best_fit_packing.lower_bound(counts, 64) + 1


def test_packing_of_no_rows(none):
    assert best_fit_packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_bin_completion_beats_or_equals_best_fit_and_finds_optima():
    assert sum(t for t, _ in best_fit_packing.bin_completion({6: 2, 5: 2, 4: 4, 3: 2}, 12)) == 4
    for seed in range(20):
        r = random.Random(seed)
        counts = Counter(r.randint(1, 60) for _ in range(r.randint(1, 60)))
        found = best_fit_packing.bin_completion(dict(counts), 100, 500)
        used = Counter()
        for times, filling in found:
            assert sum(n * q for n, q in filling) <= 100
            for n, q in filling:
                used[n] += q * times
        assert used == counts
        n = sum(t for t, _ in found)
        assert best_fit_packing.lower_bound(dict(counts), 100) <= n <= sum(t for t, _ in best_fit_packing.best_fit(dict(counts), 100))
    assert best_fit_packing.bin_completion({}) == []


# 1: pages

PAGE = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p><b>One\n two<br>three<p>four <i>fi</i>ve</article><div class=\"user-comments\"><p>nice</div><footer>&copy; x</footer>"


def test_page_texts(spark):
    rows = [(1, "http://a.example/1", PAGE, 5), (2, None, None, 5), (3, "http://a.example/2", "", 5), (4, "x", "plain &lt;b&gt; text", 5), (5, "http://a.example/3", "<article><p>x<nav>no", 5), (1, "http://a.example/1", PAGE, 5)]
    got = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((i, t, len(t)) for i, t in [(1, "Head & more One two three four five")] * 2 + [(2, ""), (3, ""), (4, "plain <b> text"), (5, "x")])
    assert html_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def extracted(spark, sources, parts=3):
    """Texts of pages of one host."""
    rows = spark.createDataFrame([(i, f"http://a.example/{i}", x) for i, x in enumerate(sources)], "page_id long, url string, html string").repartition(parts)
    return [r.text for r in html_text.page_texts(rows).orderBy("page_id").collect()]


def test_templates_are_deduced_where_places_say_nothing(spark):
    make = lambda k: f"<body><div class=x1>Welcome to our site</div><div class=x2><p>story {k} {'abc' * k}</p><p>more {k}</p></div><div class=x3>All rights reserved</div></body>"
    got = extracted(spark, [make(k) for k in range(8)] + ["<article><p>a copied page</p></article>"] * 9)
    assert got == [f"story {k} {'abc' * k} more {k}".replace("  ", " ").strip() for k in range(8)] + ["a copied page"] * 9


def test_near_copies_on_a_host_keep_their_article(spark):
    page = lambda blocks: "<body><nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body>"
    copies = [[f"copy {k}", "shared one", "shared two", "shared three", "shared four"] for k in range(40)]
    others = [[f"page {k} block {j}" for j in range(10)] for k in range(24)]
    assert extracted(spark, [page(b) for b in copies + others]) == [" ".join(b) for b in copies + others]
    boiler = [[*b, "Share this story", "All our stories"] for b in copies + others]
    assert extracted(spark, [page(b) for b in boiler]) == [" ".join(b) for b in copies + others]


def test_pages_of_large_and_hot_hosts_have_one_template(spark, monkeypatch):
    make = lambda k: f"<body><div class=x1>Welcome to our site</div><div class=x2><p>story {k}</p><p>more {k}</p></div><div class=x3>All rights reserved</div></body>"
    rows = [(k, "http://a.example/", make(k)) for k in range(200)]
    rows += [rows[0]] * 200 + [(1000 + k, "http://b.example/", make(k)) for k in range(5)] + [(2000 + k, None, make(k)) for k in range(3)]
    want = Counter((i, f"story {i % 1000} more {i % 1000}") for i, _, _ in rows)
    for parts, size in ((1, 1 << 25), (7, 0)):  # 0: hosts are joined, not broadcast
        monkeypatch.setattr(html_text, "BROADCAST_BYTES", size)
        got = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts))
        assert Counter((r.page_id, r.text) for r in got.collect()) == want


def test_classes_are_ordered_and_nested():
    def tested(sequence, classes):
        tokens = np.array(sequence, dtype=np.uint64)
        members = sorted((t, c) for c, ts in enumerate(classes) for t in ts)
        packed = html_text.Classes(np.array([t for t, _ in members], dtype="<u8").tobytes(), np.array([c for _, c in members], dtype="<i4").tobytes())
        return {c: good for c, _, _, _, good in packed.tested(tokens, np.ones(len(tokens), dtype=np.uint8))}

    assert tested([1, 9, 3, 4, 2], [[1, 2], [3, 4]]) == {0: True, 1: True}  # inside one gap
    assert tested([1, 3, 2, 4], [[1, 2], [3, 4]]) == {0: True, 1: False}  # across a token of the outer class
    assert tested([1, 2, 2, 1], [[1, 2]]) == {0: False} and tested([1, 2, 8, 1, 2], [[1, 2]]) == {0: True} and tested([1, 2, 1], [[1, 2]]) == {0: False}


def main(source):
    none = np.zeros(0, dtype=np.uint64)
    return html_text.main_text(html_text.parsed(source), none, none)


def test_regions_of_inline_and_loose_elements():
    assert main("<article>a<span hidden>no</span> b <a class='share-button'>Share <b>it</b></a> c<p class=ad>x<p>d</article>") == "a b c d"
    assert main("<article><ul><li class='advert'>q<p>r</p></li><li>keep</li></ul><p><span style='display:none'>s<p>t</article>").endswith("keep t")
    assert main("<article><div class='related-work'>earlier work</div><div class='related-articles'>links</div><div class=share>x</div></article>") == "earlier work"
    assert main("<form><div>The whole page is in a form</div><nav>menu</nav></form>") == "The whole page is in a form"
    assert main("<div><p>A page with a search box and some text of its own.</p><form>Search</form></div>") == "A page with a search box and some text of its own."


def test_open_quotes_and_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert main("<p>a <a href='x>b</a> \" c</p>" * 20_000).startswith("a b")
    assert len(main("<div><p>" + "long " * 500_000 + "</p></div>")) == 2_499_999
    assert time.perf_counter() - began < 20


def test_malformed_pages_never_fail(spark):
    r = random.Random(5)
    parts = ["<", ">", "<p", "<!--", "-->", "<nav>", "</nav>", "<article>", "</div>", "text", '"', "'", "<a href='", "<script>", "</script", "&amp", "<![CDATA[", "]]>", "\x00", "<div class=ad>", "<span hidden>", "<li class=ad>"]
    assert len(extracted(spark, ["".join(r.choices(parts, k=30)) for _ in range(300)])) == 300


# 2: lines


def naive_lines(corpus):
    """First-come filter with an explicit edit distance in words."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < line_dedup.NEAR_WORDS:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    lines = [(d, line_dedup.text_key(line_dedup.bytes_of(t)), k, tuple(x.encode().split())) for d, t, *_ in {(r[0], r[1]): r for r in corpus}.values() for k, x in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if len(x[3]) >= line_dedup.LEAST_WORDS), key=lambda x: x[:3])
    firsts, gone, drop = {}, set(), defaultdict(set)
    for d, t, k, w in lines:
        firsts.setdefault(w, (d, t, k))
    for w, at in firsts.items():
        if any(v != w and firsts[v] < at and near(v, w) for v in firsts):
            gone.add(w)
    for d, t, k, w in lines:
        if firsts[w] != (d, t, k) or w in gone:
            drop[d, t].add(k)
    return drop


def test_line_dedup_equals_brute_force(docs, corpus):
    drop = naive_lines(corpus)
    want = Counter()
    for row in corpus:
        t = row[1]
        lost = drop[row[0], line_dedup.text_key(line_dedup.bytes_of(t))]
        kept = t if not lost else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
        want[(row[0], kept, len(lost))] += 1
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == want
    assert sum(map(len, drop.values())) > 5


def test_short_and_unspaced_lines_are_deduplicated(spark):
    chinese = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    repeated = ["Les.", "two words", "one two three four", "x" * 19, "five words make a line", chinese, "😀" * 25 + "é", "http://a.example/a/long/path?of=one&word=0"]
    near = [("one of five words here", "one of 5 words here"), ("now six words are in it", "now six words are in"), ("字" + chinese[1:], None), (chinese[:-1], None), ("http://a.example/a/long/path?of=one&word=1", None), ("all in twentychars ok", "all in twentychars  ok!")]
    apart = ["les.", "two word", "a2b", "x" * 18, "one two three five", "", "  ", "fve words make line", chinese[2:] + "ab"]
    texts = [(0, "\n".join(repeated + [a for a, _ in near if a[0] in "ona"])), (1, "\n".join(["Les.", *repeated, *(b or a for a, b in near), *apart, "  two\twords "]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[0] == (texts[0][1], 0)
    assert got[1] == ("\n".join(apart), 1 + len(repeated) + len(near) + 1)


def test_line_dedup_of_no_rows(none):
    assert line_dedup.line_dedup(none).collect() == []


# 3: mixing


def test_targets():
    assert budget_mix.targets([100, 100, 100]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert budget_mix.targets([]) == [] and budget_mix.targets([0, 0]) == [0.0, 0.0]
    assert sum(budget_mix.targets([5, 900, 33, 0, 7])) == pytest.approx(1.5 * 945)


def test_subset_sums_are_the_best_reachable():
    for seed in range(40):
        r = random.Random(seed)
        lengths = r.sample(range(1, 30), r.randint(1, 6))
        counts = [r.randint(1, 4) for _ in lengths]
        budget = r.randint(0, 80)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = budget_mix.knapsack(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts, strict=True))
        assert sum(n * k for n, k in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)


def test_fit_of_very_long_documents():
    assert budget_mix.fit_counts([450_000], [2], 500_000) == (0, [1])
    assert budget_mix.fit_counts([900_000], [1], 540_000) == (0, [1])
    assert budget_mix.fit_counts([900_000], [1], 440_000) == (0, [0])
    assert budget_mix.fit_counts([200_000, 300_000], [2, 1], 400_000) == (0, [2, 0])
    r = random.Random(7)
    for _ in range(20):
        lengths = sorted(r.sample(range(60_000, 900_000), 5))
        counts = [r.randint(1, 2) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        goal = r.randrange(min(max(sums), 3 * lengths[-1]))
        passes, taken = budget_mix.fit_counts(lengths, counts, goal)
        assert passes == 0 and all(0 <= k <= c for k, c in zip(taken, counts, strict=True))
        got = abs(sum(n * k for n, k in zip(lengths, taken, strict=True)) - goal)
        # within four of the longest the program alone decides
        assert got == min(abs(s - goal) for s in sums) if goal <= 2 * lengths[-1] else got <= lengths[-1]


def test_mix(docs, corpus):
    got = budget_mix.budget_mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode().split())) for d, t, *_ in corpus)
    source = {row[0]: row[3] for row in corpus}
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    order = ["a", "b", "c", None]
    aims = dict(zip(order, budget_mix.targets([sizes[s] for s in order]), strict=True))
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(aims[source[r.doc_id]])
    for s in order:
        assert abs(taken[s] - aims[s]) <= 130
    assert sorted(map(tuple, got)) == sorted(map(tuple, budget_mix.budget_mix(docs.repartition(5)).collect()))
    rows = Counter(r.doc_id for r in budget_mix.mixed(docs).collect())
    assert rows == Counter({r.doc_id: 0 for r in got}) + Counter({k: v for k, v in sum((Counter({r.doc_id: r.taken // max(r.size, 1)}) for r in got), Counter()).items() if v})


def test_mix_with_hash_buckets(spark, monkeypatch):
    monkeypatch.setattr(budget_mix, "BUCKET_ROWS", 7)
    rows = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "u") for i in range(200)], "doc_id long, text string, source string")
    got = budget_mix.budget_mix(rows).toPandas()
    assert abs(got["taken"].sum() - 900) <= 6


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(7, " ".join(["w"] * 20), "a")] * 90 + [(None, " ".join(["v"] * 10), "b")] * 40 + [(8, " ".join(["u"] * 10), "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = budget_mix.budget_mix(docs).toPandas()
    for source, unit in (("a", 20), ("b", 10)):
        part = got[got["size"] == unit]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= unit and set(part["taken"]) <= {0, unit, 2 * unit}
    assert budget_mix.mixed(docs).count() == got["taken"].where(got["size"] == 20, 0).sum() / 20 + got["taken"].where(got["size"] == 10, 0).sum() / 10


def test_columns_that_clash_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a line of five words\na line of five words", 77, 5)], "doc_id long, text string, n_removed int, n_lines int")
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"] and got.first().n_removed == 1 and got.first().n_lines == 2


def test_mix_of_no_rows(none):
    assert budget_mix.budget_mix(none).collect() == [] and budget_mix.mixed(none).collect() == []


# 4: vectors


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(r.normal(size=(180, 8)))]
    rows += [(200, rows[0][1], 1), (250, rows[3][1], 1), (300, None, 1), (350, [], 1), (400, [1.0, None], 1), (450, [float("nan")] * 8, 1), (500, [float("inf")] * 8, 1), (550, [2.0], 1), (100, rows[100][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    from pyspark.sql import functions as F

    got = [tuple(x) for x in vector_topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=32, query_rows=2, shards=3).collect()]
    use = [(i, np.pad(np.floor(256 * np.array(v)).astype(int), (0, 8 - len(v)))) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for n, (q, x) in enumerate(use):
        if q % 50 == 0:
            best = sorted((-int(x @ v), i) for m, (i, v) in enumerate(use) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want) and (350, 1) in {x[:2] for x in got}


def test_cells_bound_scores_and_save_reads():
    r = np.random.default_rng(4)
    exact = np.floor(256 * r.normal(size=(4000, 7)) * r.lognormal(size=(4000, 1))).astype(np.int64)
    low, step, cells = vector_topk.approximated(exact)
    row = {"n": 4000, "dim": 7, "ids": np.arange(4000).astype("<i8").tobytes(), "width": "<i8", "exact": exact.tobytes(), "low": low.tobytes(), "step": step.tobytes(), "cells": cells.tobytes()}
    file = vector_topk.ApproximationFile(row, 9)
    none = np.zeros(0, dtype=np.int64)
    for j in range(20):
        query = np.pad(exact[j], (0, 2))
        scores = exact @ exact[j]
        assert (file.bounds(query) >= scores).all()
        file.read = 0
        got = file.top(query, j, (none, none), 5)
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != j)[:5]
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == [(-s, i) for s, i in want]
        assert file.read < 1500
        file.read = 0
        high = np.full(5, scores.max() + 10**9)  # carried from other blocks: nothing here can win
        assert file.top(query, j, (high, np.arange(5)), 5)[0].tolist() == high.tolist() and file.read == 0


def test_top_k_of_no_rows(spark):
    from pyspark.sql import functions as F

    assert vector_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


# 6: suffixes


def naive_spans(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(b for b, c in zip(t, covered, strict=False) if not c)
        runs = int((covered[:-1] & ~np.concatenate([[False], covered[:-2]])).sum()) if len(t) else 0
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [4096, 2])
def test_suffix_dedup_equals_brute_force(docs, corpus, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", chunk)
    want = Counter((row[0], *x) for row, x in zip(corpus, naive_spans([(row[1] or "").encode() for row in corpus], 200), strict=True))
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == want
    assert sum(k[2] for k in want) > 1000


def test_suffix_dedup_of_no_rows(none):
    assert suffix_dedup.suffix_dedup(none).collect() == []


def test_anchors_do_not_depend_on_parts(monkeypatch):
    r = random.Random(9)
    data = words(r, 2000, 50).encode()
    whole = [x.tolist() for x in suffix_dedup.anchors(data)]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    assert [x.tolist() for x in suffix_dedup.anchors(data)] == whole


def test_deep_shallow_order_and_prefixes():
    r = random.Random(4)
    for _ in range(30):
        n = r.randint(1, 40)
        strings = [bytes(r.choice(b"ab\x00") for _ in range(r.choice([0, 3, 20, 40]))) for _ in range(n)]
        strings = [r.choice(strings)[: r.randint(0, 40)] + s[:20] for s in strings]
        group = np.array([r.randint(0, 2) for _ in strings])
        width = 64
        matrix = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(n, width)
        order, prefix = deep_shallow.deep_shallow(group, matrix, np.array([len(s) for s in strings]))
        assert sorted(order.tolist()) == list(range(n))
        for depth in (0, 1, 5, 17, 30):
            number = np.empty(n, dtype=int)
            number[order] = np.cumsum(prefix < depth)
            for i in range(n):
                for j in range(n):
                    if len(strings[i]) >= depth and len(strings[j]) >= depth:
                        assert (number[i] == number[j]) == (group[i] == group[j] and strings[i][:depth] == strings[j][:depth])


# 7: quality


def naive_stats(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rule_stats(corpus):
    for _, t, *_ in corpus:
        assert rule_stats.rule_stats(t) == naive_stats(t)


def test_quality_rules(spark, docs, corpus, none):
    r = random.Random(8)
    good = [(1000 + i, words(r, r.randint(20, 300)), 1) for i in range(400)]
    bad = [(2000 + i, " ".join(x + r.choice(["***", "###", "&&&"]) for x in words(r, r.randint(20, 300)).split()), 0) for i in range(60)]
    table = spark.createDataFrame([(d, t) for d, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([*((d, q, 0) for d, _, q in good + bad), (None, 1, 0), (1000, None, 0), (1000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(table, labels)
    kept = {x.doc_id: x.kept for x in quality_rules.with_quality(table, model).collect()}
    assert sum(kept[d] for d, _, _ in good) >= 396 and sum(kept[d] for d, _, _ in bad) <= 12
    out = quality_rules.with_quality(docs, model)
    assert out.columns[: len(docs.columns)] == docs.columns
    for x in out.collect():
        n, _, _, _, rep = naive_stats(x.text)
        assert x.base_failed == (n < 20 or 100 * rep > 30 * n) and not (x.base_failed and x.kept)
    assert quality_rules.quality_rules(none, labels).collect() == []
    unlabelled = quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(unlabelled) == len(corpus) and all(x.kept == (not x.base_failed) for x in unlabelled)
    again = quality_rules.fit(table.repartition(4), labels)
    assert again.forest.cut.tolist() == model.forest.cut.tolist() and again.thresholds.tolist() == model.thresholds.tolist()


# 8: licences


def test_license_scan(spark, docs, none):
    r = random.Random(6)
    names = list(license_scan.TEMPLATES)
    rows = [(i, words(r, r.randrange(90)) + " " + license_scan.TEMPLATES[names[i % len(names)]] + " " + words(r, r.randrange(90)), names[i % len(names)]) for i in range(44)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, license string"))
    found = defaultdict(set)
    for x in got.collect():
        found[x.doc_id].add(x.license)
        assert 100 * x.n_matched >= 80 * x.n_shingles
    assert all(n in found[i] for i, _, n in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert license_scan.license_scan(docs).collect() == [] and license_scan.license_scan(none).collect() == []


def test_license_scan_finds_templates_damaged_up_to_the_bound(spark):
    r, rows, want = random.Random(8), [], set()
    for i in range(400):
        name, text = list(license_scan.TEMPLATES.items())[i % len(license_scan.TEMPLATES)]
        whole = license_scan.template_words(text)
        sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        damaged, before = whole, whole
        while 100 * len(sets(damaged) & sets(whole)) >= 80 * len(sets(whole)):  # as much damage as the bound lets through
            before, damaged = damaged, list(damaged)
            damaged[r.randrange(len(damaged))] = f"zz{r.randrange(10**6)}"
        rows.append((i, words(r, r.randrange(200)) + " " + " ".join(before) + " " + words(r, r.randrange(200))))
        want.add((i, name))
    got = {(x.doc_id, x.license) for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got


# 10: similarity groups


def naive_groups(corpus):
    sets = []
    for d, t, *_ in corpus:
        w = bytes(t or "", "utf-8").lower().split()
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_groups_equal_brute_force(docs, corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    got = Counter(map(tuple, jaccard_join.jaccard_groups(docs, sketch_bits=16).collect()))
    assert got == naive_groups(corpus)


def test_a_large_family_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    r = random.Random(12)
    base = words(r, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((i, " ".join(w), "", "", 0, "", 0, "", 0.0))
    got = Counter(map(tuple, jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOC), sketch_bits=16).collect()))
    assert got == naive_groups(rows)


def test_only_shared_shingles_are_posted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard_join, "written", lambda df, f=jaccard_join.written: seen.append(f(df)) or seen[-1])
    r = random.Random(8)
    texts = [" ".join(f"w{r.random()}" for _ in range(100)) for _ in range(30)]
    # a passage in the last ten, which are no more alike than that
    rows = [(k, t + " some words that many of these documents have" * (k >= 20)) for k, t in enumerate(texts)] + [(30, texts[0] + " more")]
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(30)} | {30: 0}
    posted = {x.id: len(x.prefix) // 8 for x in seen[0].filter("prefix is not null").collect()}
    assert set(posted) == {0, 30} and len(seen[1].filter("v is not null").collect()) == 1


def test_jaccard_groups_of_no_rows(none):
    assert jaccard_join.jaccard_groups(none, sketch_bits=16).collect() == []


def test_derived_overlaps_equal_counted_ones():
    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(1, 40))], dtype=np.uint64)) for _ in range(40)]
    block = jaccard_join.Block(sets)
    for i, found in block.links(np.arange(len(sets))):
        want = [j for j in range(len(sets)) if j != i and 5 * len(np.intersect1d(block.sets[i], block.sets[j])) >= 4 * len(np.union1d(block.sets[i], block.sets[j]))]
        assert sorted(found.tolist()) == want


def test_word_hashes_of_pieces(monkeypatch):
    data = b" a bb\tccc\n\x0bdd\x1ce " * 50
    h, start = wordhash.word_hashes(data)
    assert len(h) == len(data.split()) and [data[s : s + 1] for s in start] == [w[:1] for w in data.split()]
    by_word = {}
    for x, w in zip(h.tolist(), data.split(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(wordhash, "PIECE_BYTES", 16)
    again = wordhash.word_hashes(data)
    assert again[0].tolist() == h.tolist() and again[1].tolist() == start.tolist()


def test_shingles():
    assert len(shingles.shingle_set(None)) == len(shingles.shingle_set(" \n")) == 0
    assert len(shingles.shingle_set("a b c")) == 1 and len(shingles.shingle_set("a b c d e f")) == 2
    assert shingles.shingle_set("A b C d E").tolist() == shingles.shingle_set("a b c d e").tolist()
    assert shingles.shingle_set("É b c d e").tolist() != shingles.shingle_set("é b c d e").tolist()


def test_documents_with_null_and_repeated_ids_are_linked(spark):
    r = random.Random(3)
    base = words(r, 60).split()
    text = " ".join(base)
    rows = [(None, " ".join([*base, "one"])), (5, text), (None, " ".join([*base, "one"])), (7, words(r, 50)), (7, text), (None, words(r, 40)), (9, "a" * 700), (10, "b" * 700)]
    got = Counter(map(tuple, jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=12).collect()))
    assert got == Counter([(None, 57, 5), (5, 56, 5), (None, 57, 5), (7, 46, 7), (7, 56, 5), (None, 36, None), (9, 1, 9), (10, 1, 10)])


def test_regular_words_have_hashes_of_their_own():
    def thue(a, b, k):
        return (a, b) if not k else (x := thue(a, b, k - 1), (x[0] + x[1], x[1] + x[0]))[1]

    a, b = thue(b"a", b"b", 11)
    assert wordhash.word_hashes(a)[0] != wordhash.word_hashes(b)[0]
    a, b = thue(b"a", b"b", 7)
    assert wordhash.word_hashes(a)[0] != wordhash.word_hashes(b)[0]


@pytest.mark.parametrize("heavy", [components.HEAVY, 10])
def test_components(spark, heavy, monkeypatch):
    monkeypatch.setattr(components, "FOREST_EDGES", 8)
    r = random.Random(heavy)
    edges = [(1, k) for k in range(2, 60)] + [(k, k + 1) for k in range(100, 180)] + [(300, 299)] * 3 + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(150)] + [(1000, 1000), (None, 3), (5000, 100), (5000, 2)]
    edges += [(7000, k) for k in range(7001, 7200)] + [(7000, 42)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5), heavy=heavy).collect()}
    label = {}
    for u, v in edges:
        if u is not None and u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    while True:
        before = dict(label)
        for u, v in edges:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
        if label == before:
            break
    assert got == label
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_candidate_lists_over_several_tasks_stay_connected():
    r = random.Random(5)
    rows = sorted((h, r.randint(50, 60), node, r.randint(0, 5)) for h in (1, 2, 3) for node in r.sample(range(1000), 200))
    table = [np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)]

    def run(cols, step):
        return [b for b in jaccard_join.candidate_edges(pa.RecordBatch.from_arrays([pa.array(c[lo : lo + step]) for c in cols], ["h", "n", "node", "at"]) for lo in range(0, len(cols[0]), step))]

    def links(batches):
        return {(u, v) for b in batches for u, v, h in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), strict=True) if h is None}

    cuts = [0, 7, 60, 61, 250, 420, 600]
    parts = [run([c[a:b] for c in table], 50) for a, b in zip(cuts, cuts[1:], strict=False)]
    ends = sorted((h, n, u, at) for part in parts for b in part for u, h, n, at in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True) if h is not None)
    edges = set().union(*map(links, parts), links(run([np.array(x, dtype=np.int64) for x in zip(*ends, strict=True)], 70)))
    child, root = components.forest(*(np.array(x) for x in zip(*edges, strict=True)))
    label = dict(zip(child.tolist(), root.tolist(), strict=True))
    for h in (1, 2, 3):  # lengths are close, so each list is one group of candidates
        assert len({label.get(x[2], x[2]) for x in rows if x[0] == h}) == 1


def test_near_lines_are_verified_on_their_parts():
    assert line_dedup.within_one("a b c d e", "a b x d e")
    assert line_dedup.within_one("a b c d e", "a b c d e f")
    assert line_dedup.within_one("x" * 30, "x" * 14 + "y" + "x" * 15)
    assert not line_dedup.within_one("a b c d e", "a b c e d")
    assert not line_dedup.within_one("a b c d e", "a b c d e f g")
    assert not line_dedup.within_one("a b c d e", "a x c y e")
    assert not line_dedup.within_one("aaaa bbbb cccc dddd", "aaaa bbbb cccc dddd e")  # characters against words


def test_a_pair_that_only_its_hashes_join_is_not_verified(spark):
    texts = ["one two three four five", "one two three four six", "six five four three two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    h = [int(line_dedup.Lines([t.encode()]).hash.view(np.int64)[0]) for t in texts]
    t = [line_dedup.text_key(x.encode()) for x in texts]
    pairs = spark.createDataFrame([(h[1], t[1], h[0], t[0]), (h[2], t[2], h[0], t[0])], "h long, t long, other_h long, other_t long")
    assert [r["h"] for r in line_dedup.verified(docs, pairs).collect()] == [h[1]]


def test_multikey_quicksort_orders_and_finds_runs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        group, chars = rng.integers(0, 4, n), rng.integers(0, 5, (n, 3)).astype(np.uint64)
        order, starts = deep_shallow.multikey_quicksort(group, chars)
        key = [(int(group[i]), *chars[i].tolist()) for i in order]
        assert key == sorted(key)
        assert starts.tolist() == [i for i in range(n) if i == 0 or key[i] != key[i - 1]]
