"""The dealt operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curbflow.llm import language, main_text, near_duplicates, neighbours, packing, pieces, quality_model, quality_rules, registry, sharding, toxicity
from curbflow.llm.common import Store
from curbflow.llm.components import components

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e " * 4000), (6, "▁ x\x00y 😀 é"), (7, "same text here"), (7, "same text here"), (None, "no id here"), (8, "same text here")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 5.0) for i, t in ODD], "doc_id long, text string, n_words string, score double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1 Sharding


@pytest.mark.parametrize("limit", [1000, 100])
def test_sharding_fits(spark, limit):
    rows = [(i, "x" * (i % 50)) for i in range(2000)] + [(7, "y" * 90)] * 300 + [(None, None)] * 5 + [(9999, "z" * 5000)]
    own = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", F.octet_length("text"), limit).collect()
    assert len(own) == len(rows)
    shards = collections.defaultdict(list)
    for r in own:
        shards[r.depth, r.prefix, r.page].append(r)
    for of in shards.values():
        total = sum(r.n_bytes for r in of)
        assert total == of[0].shard_bytes and len(of) == of[0].shard_rows
        assert total <= limit or len(of) == 1
    leaves = {(d, p) for d, p, _ in shards}
    assert not any((d - k, p >> k) in leaves for d, p in leaves for k in range(1, d + 1))  # prefix-free


def test_sharding_splits_only_large(spark):
    own = sharding.shard(spark.createDataFrame([(i, "x" * 10) for i in range(500)], "doc_id long, text string"), "doc_id", F.octet_length("text"), 600).collect()
    size = collections.Counter()
    for r in own:
        for k in range(r.depth + 1):
            size[r.depth - k, r.prefix >> k] += r.n_bytes
    assert all(size[r.depth - 1, r.prefix >> 1] > 600 for r in own if r.depth)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), "doc_id", F.octet_length("text")).count() == 0


def test_sharding_is_native(docs):
    plan = sharding.shard(docs, "doc_id", F.octet_length("text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 2 HTML


def test_gradients():
    draw, words = random.Random(3), main_text.Words()
    pages = []
    while len(pages) < 3:
        page, labels = main_text.write_page(draw)
        own = main_text.blocks(page)
        if own and (y := main_text.align(own, labels)) is not None:
            pages.append((own, y))
    model = main_text.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ready, y = main_text.featurise([o for o, _ in pages], words), np.concatenate([y for _, y in pages])
    loss = lambda: float(-np.mean(y * np.log(model.scores(ready)) + (1 - y) * np.log(1 - model.scores(ready))))
    for name, grad in model.gradients(ready, y).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        was = model.p[name][at]
        model.p[name][at] = was + 1e-4
        up = loss()
        model.p[name][at] = was - 1e-4
        assert (up - loss()) / 2e-4 == pytest.approx(grad[at], rel=1e-2, abs=1e-5), name
        model.p[name][at] = was


def test_held_out_pages():
    draw, words, model, wrong, total = random.Random(99), main_text.Words(), main_text.labeller(), 0, 0
    for _ in range(150):
        page, labels = main_text.write_page(draw)
        own = main_text.blocks(page)
        if own and (y := main_text.align(own, labels)) is not None:
            wrong += int(((model.scores(main_text.featurise([own], words)) >= 0.5) != (y > 0)).sum())
            total += len(y)
    assert wrong <= 0.01 * total


def test_main_text_of_tables(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r.page_id: r for r in main_text.main_text(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        lines = [" ".join(re.sub("<[^>]+>", " ", x).replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").split()) for x in re.split("</?h1>|</?p>", re.search("<article>(.*?)</article>", r.html, re.S)[1])]
        assert found[r.page_id].text == "\n".join(filter(None, lines)) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "<p"), (4, "plain words"), (5, "<script>x</script"), (6, "<div><p>a &amp; b<p>c" + "<b>" * 500), (6, None)]
    own = spark.createDataFrame([(i, "u", h, 1) for i, h in pages], "page_id long, url string, html string, text int")
    rows = main_text.main_text(own).collect()
    assert len(rows) == len(pages) and all(r.text == "" for r in rows if r.page_id in (1, 2, 5)) and main_text.main_text(own.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<html><head><title>T</title><meta name=a><body><p>one<p>two</html>", ["one", "two"]),
        ("<html><head><title>T</title><link rel=x><article><p>one</article>", ["one"]),
        ("<head><style>p{}</style>one<p>two", ["one", "two"]),
        ("<head><title>T</title>one", ["one"]),
        ("<head><title>T</title><meta name=a></head><p>one", ["one"]),
        ("<div><button>Go<p>one</p><p>two</p></div>", ["one", "two"]),
        ("<div><object data=x><p>one</p><svg><path d=1><p>two</div>", ["one", "two"]),
        ("<select><option>A<option>B<p>one", ["one"]),
        ("<div><button>A<p>one</p><button>B</button></div>", ["one"]),
        ("<button><div>Go</div></button><object><p>no</p><object></object></object><select><option>A<option>B</select><p>one", ["one"]),
        ("<button><object><p>no</p></object><p>one", ["one"]),
    ],
)
def test_unclosed_hidden_elements(page, expected):
    assert [b.text for b in main_text.blocks(page)] == expected


def test_long_attributes():
    long = "<p>no</p>" * 2000
    for quote in "\"'":
        for tag in ("div", "iframe"):
            inner = f"<{tag} data-a = {quote}{long}</{tag}>{quote} class=x>" + (f"no</{tag}>" if tag == "iframe" else "")
            assert [b.text for b in main_text.blocks(f"{inner}<p>one</p>")] == ["one"]
    assert [b.text for b in main_text.blocks('<p title="5" tall">one</p><p class="a">two</p><p class="b>three</p>')] == ["one", "two", "three"]


# 3 Quality rules


def by_hand(text):
    text = text or ""
    words, lines = BLANKS.findall(text), [x for x in text.split("\n") if BLANKS.search(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, docs, odd):
    for own in (docs, odd):
        texts = collections.Counter((r.doc_id, *by_hand(r.text)) for r in own.select("doc_id", "text").collect())
        found = quality_rules.quality_rules(own).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == texts
        for r in found:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_compression_bands():
    import zstandard

    packer, draw = zstandard.ZstdCompressor(level=3), random.Random(1)
    noise = bytes(draw.randrange(256) for _ in range(20_000))
    assert not quality_rules.compression(b"again and again " * 500, packer)[2] and not quality_rules.compression(noise, packer)[2]
    assert quality_rules.compression(b"", packer) == (1.0, 0.0, True)


def test_quality_keeps_clean(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1")
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept for r in rows)


# 4 SimHash


def brute(prints, radius=3):
    label = {}
    for start in range(len(prints)):
        if start in label:
            continue
        label[start], stack = start, [start]
        while stack:
            u = stack.pop()
            for v in range(len(prints)):
                if v not in label and (prints[u] ^ prints[v]).bit_count() <= radius:
                    label[v] = start
                    stack.append(v)
    return label


def slow_print(text):
    import xxhash

    words = [w.encode() for w in BLANKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, odd):
    for own in (docs, odd):
        rows = own.select("doc_id", "text").collect()
        prints = [slow_print(r.text) for r in rows]
        label = brute(prints)
        smallest = {}
        for i, r in enumerate(rows):
            if r.doc_id is not None:
                smallest[label[i]] = min(r.doc_id, smallest.get(label[i], r.doc_id))
        expected = collections.Counter((r.doc_id, near_duplicates.signed(p), smallest.get(label[i])) for i, (r, p) in enumerate(zip(rows, prints)))
        assert collections.Counter(map(tuple, near_duplicates.near_duplicates(own).collect())) == expected


def test_masks_cover():
    draw = random.Random(2)
    for level in range(3):
        family = near_duplicates.masks(3, level)
        assert len(family) == 15
        for _ in range(300):
            bits = draw.sample(range(64), 3)
            assert any(not any(m >> b & 1 for b in bits) for m in family)


@pytest.mark.parametrize("most", [4096, 6])
def test_dense_buckets(spark, most):
    draw, prints = random.Random(4), set()
    for _ in range(4):
        base = draw.getrandbits(64)
        for _ in range(120):
            x = base
            for b in draw.sample(range(64), draw.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints, store = sorted(prints), Store(spark)
    df = spark.createDataFrame([(near_duplicates.signed(p),) for p in prints], "fp long")
    found = {r.node: r.label for r in components(near_duplicates.links(df, store, 3, most), store).collect()}
    groups = lambda of: sorted(sorted(g) for g in of.values())
    ours, theirs = collections.defaultdict(list), collections.defaultdict(list)
    for i, k in brute(prints).items():
        theirs[k].append(i)
        ours[found.get(near_duplicates.signed(prints[i]), ("alone", i))].append(i)
    assert groups(ours) == groups(theirs)


def test_components_of_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    label = {r.node: r.label for r in components(edges, Store(spark)).collect()}
    assert {label[i] for i in range(201)} == {0} and label[501] == 500


def test_keep_first(spark, odd):
    kept = near_duplicates.keep_first(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 6, 7, None]


# 5 Pieces


def test_pieces_score_and_round_trip(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    own = pieces.model(pieces.vocabulary())
    texts = [r.text for r in docs.limit(60).collect()] + [t or "" for _, t in ODD] + ["日本語 テスト", "a  b", "  x ", "y" * 500]
    found = own.encode([t.encode() for t in texts])
    assert [own.decode(x).decode() for x in found] == texts
    assert sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary()).get_piece_size() == len(own.texts)


def test_viterbi_is_best():
    own, draw = pieces.model(pieces.vocabulary()), random.Random(6)
    table = {own.texts[i]: own.scores[i] for i, k in enumerate(own.kinds) if k == pieces.NORMAL}
    for _ in range(40):
        text = "".join(draw.choice("etaoin shr") for _ in range(draw.randint(1, 12))).encode()
        line = (b" " + text).replace(b" ", "▁".encode())
        best = [0.0] + [-np.inf] * len(line)
        for i in range(len(line)):
            for j in range(i + 1, len(line) + 1):
                if best[i] > -np.inf and line[i:j] in table:
                    best[j] = max(best[j], best[i] + table[line[i:j]])
        ids = own.encode([text])[0]
        assert b"".join(own.texts[i] for i in ids) == line and sum(own.scores[i] for i in ids) == pytest.approx(best[-1])


def test_pieces_operator(spark, odd):
    rows = pieces.decode(pieces.encode(odd.filter("doc_id IS NOT NULL"))).collect()
    assert all(r.decoded == (r.text or "") for r in rows)


# 6 Quality model


def test_quality_model(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality_model.quality(docs, ["doc_id", "text"]).join(labels, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert right >= 0.9 * len(rows)
    few = quality_model.quality(odd, ["doc_id", "text"]).collect()
    assert len(few) == len(ODD) and not any(r.kept for r in few if not (r.text or "").strip())
    assert quality_model.quality(odd.limit(0), ["doc_id", "text"]).count() == 0


def test_em_finds_accuracies():
    draw, truth = np.random.default_rng(1), None
    truth = draw.random(4000) < 0.85
    own = np.full((4000, quality_model.LABELLERS), quality_model.NONE)
    for k, (hit, false) in enumerate([(0.4, 0.01)] * quality_model.LABELLERS):
        bad = np.where(truth, draw.random(4000) < false, draw.random(4000) < hit)
        own[:, k] = np.where(bad, quality_model.BAD, quality_model.GOOD)
    codes, counts = np.unique(own @ (3 ** np.arange(quality_model.LABELLERS - 1, -1, -1)), return_counts=True)
    share, chances = quality_model.estimate(codes, counts.astype(float))
    assert share == pytest.approx(0.85, abs=0.03) and chances[0, :, quality_model.BAD].mean() == pytest.approx(0.4, abs=0.06)


# 7 Language


def test_language(spark, docs, odd):
    train = docs.filter("doc_id % 3 <> 0")
    rows = language.identify(docs, train, ["doc_id", "text", "lang"]).filter("doc_id % 3 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    few = {r.doc_id: r for r in language.identify(odd, train).collect()}
    assert few[1].lang_pred == few[2].lang_pred == few[3].lang_pred == "und" and few[4].lang_pred != "und" and few[1].lang_score == 0
    assert {r.lang_pred for r in language.identify(odd, train.limit(0)).collect()} == {"und"}
    assert language.keep_identified(odd, train).columns == odd.columns


def test_profile_ranks():
    assert language.ranking(np.array([5, 5, 9, 9, 1]), 2).tolist() == [5, 9]
    assert not len(language.ngrams("12 !?")) and len(language.ngrams("ab")) == 2 + 3 + 2 + 1


# 8 Toxicity


def test_toxicity_learns_and_locates():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts, marks = [], []
    for k in range(600):
        lines = [" ".join(word() for _ in range(8)) for _ in range(6)]
        if k % 6 == 0:
            lines[3] += " grubs" + word()[:2]
        texts.append(". ".join(lines).encode())
        marks.append(int(k % 6 == 0))
    model = toxicity.fit(texts[:400], marks[:400])
    scores, blamed = toxicity.scorer(model)(texts[400:] + [b"", None])
    assert sum((s >= 0.5) == bool(y) for s, y in zip(scores, marks[400:])) >= 198
    for text, y, found in zip(texts[400:], marks[400:], blamed):
        if y and found:
            assert "grubs" in text.decode()[found[0]["start"] : found[0]["start"] + found[0]["length"]]
    assert scores[-1] == scores[-2] < 0.5


def test_toxicity_odd(spark, odd):
    model = (-5.0, {b"word": 9.0})
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.toxic_score >= 0.5} == {4}
    assert toxicity.fit([], []) == (toxicity.START_BIAS, {})


# 9 Neighbours


def test_neighbours_recall_and_order(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in table.collect()}
    ids = np.array(sorted(rows))
    all_rows = np.array([rows[i] for i in ids])
    found = collections.defaultdict(list)
    for r in sorted(neighbours.op9_neighbours(spark, DATA).collect(), key=lambda r: r["rank"]):
        found[r.query_id].append(r)
        assert r.score == pytest.approx(float(rows[r.query_id] @ rows[r.vec_id]), abs=1e-12)
    hit = 0
    for q in ids[ids % 20 == 0]:
        score = all_rows @ rows[q]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit += len(set(best.tolist()) & {r.vec_id for r in found[q]})
        assert [(-r.score, r.vec_id) for r in found[q]] == sorted((-r.score, r.vec_id) for r in found[q]) and len(found[q]) == 20
    assert hit >= 0.9 * 20 * len(found)


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, []), (11, [1.0]), (3, [1.0, 0.0])]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.neighbours(own, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 3), (0, 2, 20), (0, 3, 4), (20, 1, 0), (20, 2, 3), (20, 3, 4)]
    assert neighbours.neighbours(own.limit(0), F.lit(True)).count() == 0
    many = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(100)], "vec_id long, embedding array<float>")
    got = [r.vec_id for r in neighbours.neighbours(many, F.col("vec_id") == 3).orderBy("rank").collect()]
    assert got == [0, 1, 2, *range(4, 21)]


# 10 Packing


def check_packing(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
    return len(sequences), -(-total // capacity)


def test_packing(spark, docs, odd):
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(packing.vocabulary())
    for own in (docs.limit(120), odd):
        rows = packing.pack(own).collect()
        expected = collections.Counter()
        for r in own.collect():
            ids = np.array(coder.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
            expected.update((r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
        used, least = check_packing(rows, 1024)
        assert used <= least + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_token_ids_are_the_librarys():
    tokenizers = pytest.importorskip("tokenizers")
    coder, draw = tokenizers.Tokenizer.from_file(packing.vocabulary()), random.Random(1)
    marks = [" ", "  ", "\n", "\t", "a", "Bc", "é", "日", "!", "1", "23", "'s", "<|endoftext|>", "\0", "😀", "\r\n", " ", "́", "²", "\x85"]
    texts = ["".join(draw.choice(marks) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    for text, ids in zip(texts, packing.tokens(packing.vocabulary()).encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_local_search_beats_best_fit():
    histogram = {12: 1, 8: 3, 5: 1, 3: 1, 9: 2, 2: 2, 11: 1}
    start = packing.best_fit(histogram, 20)
    assert (sum(n for _, n in start), sum(n for _, n in packing.improve(start, 20))) == (5, 4)
    draw = random.Random(3)
    for _ in range(60):
        own = collections.Counter(draw.randint(1, 20) for _ in range(draw.randint(1, 60)))
        first = packing.best_fit(dict(own), 20)
        last = packing.improve(first, 20)
        for classes in (first, last):
            held = collections.Counter()
            for pattern, many in classes:
                assert packing.fill(pattern) <= 20
                for k, v in pattern.items():
                    held[k] += v * many
            assert held == own
        assert sum(n for _, n in last) <= sum(n for _, n in first)


def item_by_item(histogram, capacity):
    """Room left in each sequence after best fit decreasing, one document at a time."""
    rooms = []
    for length in sorted(collections.Counter(histogram).elements(), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_start_is_best_fit_decreasing():
    draw = random.Random(4)
    cases = [({600: 40, 30: 400}, 1024), ({600: 3, 100: 50, 7: 9, 1: 2000}, 1024)]
    cases += [(collections.Counter(draw.choice((1, 2, 3, 5, draw.randint(1, 50))) for _ in range(draw.randint(1, 200))), 50) for _ in range(100)]
    for histogram, capacity in cases:
        start = packing.best_fit(histogram, capacity)
        packed = sum((collections.Counter({n: c * many for n, c in own.items()}) for own, many in start), collections.Counter())
        assert packed == collections.Counter(histogram)
        assert sorted(capacity - packing.fill(own) for own, many in start for _ in range(many)) == item_by_item(histogram, capacity)


def test_local_search_beats_item_by_item():
    histogram = {14: 1, 12: 1, 5: 1, 3: 3}
    last = packing.improve(packing.best_fit(histogram, 20), 20)
    assert (len(item_by_item(histogram, 20)), sum(n for _, n in last)) == (3, 2)
    assert sum((collections.Counter({n: c * many for n, c in own.items()}) for own, many in last), collections.Counter()) == histogram


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = Store(spark).put(function(spark, stage, DATA))
        assert stage.columns == docs.columns
        left = {r.doc_id for r in stage.collect()}
        assert left <= ids and len(left) > 0.5 * len(ids), name
        ids = left
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == ids
    check_packing(rows, 1024)


def test_registry():
    found = registry.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in found} == {str(n) for n in range(1, 11)} and set(registry.oracle_sql()) <= set(found)
