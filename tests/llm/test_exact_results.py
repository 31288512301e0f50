"""Operators against plain Python that follows the definitions, on whole small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import compression_bands as bands, decontaminate as search, personal_data, queries, secrets_grammar
from tabloom.llm.batches import SPACE

BLANK = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def result(spark, sf, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_base_counts_of_the_bands(spark, sf, rows):
    got = result(spark, sf, "op2_compression_bands")
    assert got.keys() == rows.keys()
    for i, r in rows.items():
        words = re.findall(BLANK, r.text)
        windows = list(zip(words, words[1:], words[2:]))
        often = collections.Counter(windows)
        again = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
        lines = [x for x in r.text.split("\n") if re.search(BLANK, x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert got[i][1:7] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)),
                               len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and got[i].kept)


def test_bands_reject_what_repeats_and_what_does_not_compress():
    rng = np.random.default_rng(1)
    noise = " ".join("".join(map(chr, rng.integers(33, 0x2000, 9))) for _ in range(900))
    phrase = " ".join(f"n{k}" for k in range(400))
    half = " ".join([phrase, *["one two three four five six seven eight nine ten %d" % k for k in range(150)]])
    prose = " ".join(rng.choice([f"w{k:x}{k * 7919 % 9973:x}" for k in range(3000)], 900))
    assert [list(bands.judge([t], bands.Bands())[6]) for t in (noise, half, prose)] == [[False], [False], [True]]


def find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


def classes(prints, distance=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in ids}


def simhash(text):
    words = re.findall(BLANK, lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, sf, rows):
    got = result(spark, sf, "op7_simhash_dedup")
    prints = {i: simhash(r.text) for i, r in rows.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == classes(prints)


@pytest.mark.parametrize("distance, most", [(1, 10 ** 6), (4, 10 ** 6), (4, 5), (6, 10 ** 6)])
def test_links_hold_every_component_together(spark, distance, most):
    from tabloom.llm.graph import components
    from tabloom.llm.simhash_dedup import link_fingerprints

    rng = np.random.default_rng(distance)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for base in list(prints)[:20]:
        for _ in range(30):
            prints.add(base ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components(link_fingerprints(table, distance, most)).collect()}
    want = classes({p: p % (1 << 64) for p in signed}, distance)
    groups = collections.defaultdict(set)
    for p in signed:
        groups[found.get(p, p)].add(p)
    expected = collections.defaultdict(set)
    for p, root in want.items():
        expected[root].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_wu_manber_finds_every_window():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 5, 13):
        words = [b"%d" % x for x in rng.integers(0, 3, 400)]
        patterns = {tuple(words[k:k + size]) for k in rng.integers(0, 380, 12)} | {tuple(b"%d" % x for x in rng.integers(0, 3, size))}
        tables, = search.build_tables((p, ["i"]) for p in patterns)
        got = sorted((at, tables.patterns[k]) for at, k in search.search(words, tables))
        assert got == sorted((k, tuple(words[k:k + size])) for k in range(400 - size + 1) if tuple(words[k:k + size]) in patterns)


def test_blocks_of_patterns_give_the_same(spark, sf, docs):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = search.decontaminate(docs, benchmark).collect()
    many = search.decontaminate(docs, benchmark, block_windows=400).collect()
    assert sorted(one) == sorted(many) and any(r.contaminated for r in one)


def test_blocks_are_searched_in_jobs_of_their_own(spark, sf, docs):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = search.decontaminate(docs.unionByName(docs.limit(5)), benchmark, block_windows=300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # What is left is the merging of findings: the table of texts is read without its texts.
    assert plan.count("MapInArrow") == 1
    kept = search.drop_contaminated(docs, benchmark, block_windows=300)
    assert sorted(kept.collect()) == sorted(search.drop_contaminated(docs, benchmark).collect()) and kept.columns == docs.columns


def test_token_files_round_trip(spark, sf, rows):
    got = result(spark, sf, "op9_token_files")
    tool, at = Tokenizer.from_file(queries.TOKENIZER), 0
    for i in sorted(rows):
        ids = tool.encode(rows[i].text, add_special_tokens=False).ids + [1]
        assert got[i][1:] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_words_are_encoded_as_in_their_text():
    import pyarrow as pa

    from tabloom.llm.token_files import encoder

    rng = np.random.default_rng(5)
    signs = list("aZé's <|>.,!1٣ßÿĞİΣσ́ 　 \n\t\x1c\x0b") + ["<|endoftext|>", "n't", "'ll", "中"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(1500)] + [None, "", " "]
    tool = encoder(queries.TOKENIZER)
    ids, counts = tool.encode(pa.array(texts), 1)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert tool.tokenizer.encode(text or "", add_special_tokens=False).ids + [1] == part.tolist()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [[m.span() for m in EMAIL.finditer(text)],
            [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
            [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
            [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]]


def test_personal_data_spans(rows):
    rng = np.random.default_rng(9)
    signs = list("a@.b@-_% 1234567890..++() -") + ["10.0.0.255", "256.1.1.1", "4111 1111 1111 1111", "+49 (30) 123-4567", "x@y.z"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(4000)] + [r.text for r in rows.values()]
    for t in texts:
        assert personal_data.base_spans(t) == plain_spans(t), t


def test_personal_data_query(spark, sf, rows):
    got = result(spark, sf, "op3_personal_data")
    for i, r in rows.items():
        joined = ",".join(f"{k}:{a}:{b}" for k, s in zip(personal_data.KINDS, plain_spans(r.text)) for a, b in s)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans.startswith(joined)


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets_grammar.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_secret_query(spark, sf, rows):
    got = result(spark, sf, "op10_secrets")
    for i, r in rows.items():
        found = plain_secrets(r.text)
        assert got[i][1:4] == tuple(sum(k == kind for k, _, _ in found) for kind in secrets_grammar.KINDS)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(got[i].spans.split(",")) | {""}


def test_pipeline_against_plain_python(spark, sf, rows):
    kept = {r.doc_id for r in bands.compression_bands(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.kept}
    groups = classes({i: simhash(rows[i].text) for i in kept})
    kept = {i for i in kept if groups[i] == i}
    items = [[w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))]
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k:k + 13]) for w in items for k in range(max(1, len(w) - 12)) if w}

    def contaminated(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hit = {p + d for size in {len(w) for w in windows} for p in range(len(words) - size + 1)
               if tuple(words[p:p + size]) in windows for d in range(size)}
        return bool(hit) and 20 * len(hit) >= len(words)

    kept = {i for i in kept if not contaminated(rows[i].text)}
    sources = collections.defaultdict(list)
    for i in kept:
        sources[rows[i].source].append((hashlib.md5(str(i).encode()).hexdigest(), i))
    size = {i: len(re.findall(BLANK, rows[i].text)) for i in kept}
    total = {s: sum(size[i] for _, i in found) for s, found in sources.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sources))}
    target, open_ = {}, set(total)
    while True:
        rest = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * total[s] for s in full}
        open_ -= full
    texts = []
    for s, found in sources.items():
        left = round(target[s])
        for _, i in [*sorted(found), *sorted(found)]:
            take = min(left, size[i])
            left -= take
            if take:
                words = list(re.finditer(BLANK, rows[i].text))
                texts.append((i, rows[i].text if take == size[i] else rows[i].text[:words[take - 1].end()]))
    tool = Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for i, t in texts:
        ids = tool.encode(t, add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_blanks_agree():
    assert bytes(b for b in range(256) if not bytes([b]).split()) == bytes(sorted(SPACE))


def test_bands_reject_bad_documents_and_keep_good_ones(spark):
    """On labelled documents that set no limit: at least half of the bad ones that pass the base rules, at most 1 % of the good."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("crc32(CAST(doc_id AS STRING)) % 4 = 2")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = bands.compression_bands(docs).where("NOT base_failed").join(labels, "doc_id")
    share = {r.quality: (r.n, r.rejected) for r in judged.groupBy("quality").agg(
        F.count("*").alias("n"), F.avg((~F.col("kept")).cast("int")).alias("rejected")).collect()}
    assert share[0][0] > 50 and share[0][1] > 0.5
    assert share[1][0] > 500 and share[1][1] < 0.01


def test_verdicts_of_the_bands_against_a_loop(spark, sf, rows):
    """Every text and every piece of it pressed one by one, with limits read off the table by hand."""
    import math

    import zstandard

    b = bands.Bands()

    def low_high(size):
        low, high = [(x, y) for at, x, y in b.document if at <= size][-1]
        if size >= b.lowest[-1][0]:
            return b.lowest[-1][1], high
        for (p, x), (q, y) in zip(b.lowest, b.lowest[1:]):
            if p <= size < q:
                low = x + (y - x) * (math.log2(size) - math.log2(p)) / (math.log2(q) - math.log2(p))
        return low, high

    def inside(raw, low, high):
        return low <= len(zstandard.ZstdCompressor(level=b.level).compress(raw)) / len(raw) <= high

    got = result(spark, sf, "op2_compression_bands")
    for i, r in rows.items():
        raw = r.text.encode()
        keep = not got[i].base_failed and inside(raw, *low_high(len(raw)))
        if keep and len(raw) > b.chunk_bytes:
            outside = 0
            pieces = [raw[k:k + b.chunk_bytes] for k in range(0, len(raw), b.chunk_bytes)]
            for piece in pieces:
                if len(piece) == b.chunk_bytes:
                    outside += not inside(piece, b.chunk_low, b.chunk_high)
                else:
                    piece = piece if len(piece) >= b.tail_bytes else raw[-b.tail_bytes:]
                    outside += not inside(piece, *low_high(len(piece)))
            allowed = [s for n, s in b.chunk_share if n <= len(pieces)][-1]
            keep = outside / len(pieces) <= allowed
        assert got[i].kept == keep
    assert any(not got[i].kept and not got[i].base_failed for i in rows)
