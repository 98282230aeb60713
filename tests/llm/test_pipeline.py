"""The pipeline's stages keep their contract on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sonospan.llm import budget_mix, line_dedup, quality_rules

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema if len(out) < 4 else None) if len(out) < 4 else stage(spark, docs, SMALL)
        out.append(docs)
    return spark.read.parquet(f"{SMALL}/documents.parquet"), out


def test_stages(stages):
    docs, out = stages
    for df in out[:-1]:
        assert df.columns == docs.columns
    counts = [df.count() for df in (docs, *out[:3])]
    assert counts == sorted(counts, reverse=True) and counts[3] > 0.7 * counts[0]
    packed = out[-1].toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 2048) + 2


def test_near_copies_are_gone(spark, stages):
    from sonospan.llm.jaccard_join import jaccard_groups

    groups = jaccard_groups(stages[1][2], sketch_bits=16).collect()
    assert all(r.doc_id == r.component_id for r in groups)


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_one_row_of_each_group_stays(spark):
    text, other = " ".join(f"word{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, other), (None, other), (2, text + " more"), (2, "a text of its own that nothing else is like"), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, SMALL).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2], *rows[5:]]))


def naive_quality(rows, model):
    """Base limits, then every tree walked node by node."""
    for row in rows:
        text = row["text"] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        stats = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        if len(w) < 20 or 100 * len(repeated) > 30 * len(w):
            continue
        if model.forest is not None:
            f, x, total = model.forest, quality_rules.rates(np.array([stats]))[0], 0.0
            for t in range(len(f.feature)):
                at = 0
                while f.left[t][at] != at or f.right[t][at] != at:
                    at = f.left[t][at] if x[f.feature[t][at]] < f.cut[t][at] else f.right[t][at]
                total += f.path[t][at]
            score = 2.0 ** (-total / len(f.feature) / float(quality_rules.expected_path(f.tree_rows)))
            if score > model.thresholds[quality_rules.band(np.array([len(w)]))[0]]:
                continue
        yield row


def naive_line_dedup(rows):
    """Every line against every earlier one."""

    def parts(line):
        return line if len(line) >= 5 else b" ".join(line).decode()

    def near(a, b):
        if type(a) is not type(b) or abs(len(a) - len(b)) > 1 or (isinstance(a, str) and min(len(a), len(b)) < 20):
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    rows = sorted(rows, key=lambda r: (r["doc_id"], line_dedup.text_key(line_dedup.bytes_of(r["text"]))))
    seen, by_length = set(), defaultdict(list)
    for row in rows:
        kept = []
        for line in (row["text"] or "").split("\n"):
            w = tuple(line.encode().split())
            if w and w in seen:
                continue
            if w:
                seen.add(w)
                p = parts(w)
                others = [o for n in (len(p) - 1, len(p), len(p) + 1) for o in by_length[n]]
                by_length[len(p)].append(p)
                if any(near(p, o) for o in others):
                    continue
            kept.append(line)
        text = "\n".join(kept)
        if text.encode().split():
            yield row | {"text": text, "n_chars": len(text)}


def naive_near_copies(rows):
    """The smallest id of every component of linked rows."""
    sets = []
    for row in rows:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), row["text"]).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if k == old else k for k in root]
    groups = defaultdict(list)
    for row, k in zip(rows, root, strict=True):
        groups[k].append(row)
    return [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]


def test_stages_equal_brute_force(spark, stages):
    docs, out = stages
    read, good, lines, single, mix, packed = [[r.asDict() for r in df.collect()] for df in (docs, *out)]
    rows = lambda x: Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in x)
    model = quality_rules.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert model.forest is not None and len(read) > len(good) and rows(lines) != rows(good)
    assert rows(good) == rows(naive_quality(read, model))
    assert rows(lines) == rows(naive_line_dedup(good))
    assert rows(single) == rows(naive_near_copies(lines))
    # line dedup leaves no near copies in this table: the stage is also held against the rows that went into it
    earlier = [r.asDict() for r in corpus_pipeline.near_copies(spark, out[0], SMALL).collect()]
    assert rows(earlier) == rows(naive_near_copies(good)) and len(earlier) < len(good)

    times, have = rows(mix), rows(single)
    assert set(times) <= set(have) and all(n <= 2 * have[r] for r, n in times.items())
    sizes, taken = defaultdict(list), Counter()
    for r in single:
        sizes[r["source"]].append(len(r["text"].encode().split()))
    for r in mix:
        taken[r["source"]] += len(r["text"].encode().split())
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    for s, aim in zip(order, budget_mix.targets([sum(sizes[s]) for s in order]), strict=True):
        reachable = 1  # bit n: some documents, whole passes apart, have n words
        for n in sizes[s]:
            reachable |= reachable << n
        whole = int(aim // sum(sizes[s])) * sum(sizes[s])
        best = min(abs(whole + n - aim) for n in range(reachable.bit_length()) if reachable >> n & 1)
        assert abs(taken[s] - aim) <= best + 1

    tok, want, ends = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for r in mix:
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4")
            want[r["doc_id"], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    for r in packed:
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for places in ends.values():
        places.sort()
        assert [0, *(e for _, e in places[:-1])] == [b for b, _ in places] and places[-1][1] <= 2048
