import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import abuse, bpe, forms, neardup, packing, pieces, quality, queries, repeated, scans, sentences
from tessella.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


CHUNK = "id bigint, source string, document string, page int, chunk_on_page int, text string, lang string, extra string"


def chunks(spark, rows):
    """Rows of (id, source, document, page, text, lang), with a column of a clashing kind."""
    return spark.createDataFrame([(i, s, d, p, 1, t, g, "x") for i, s, d, p, t, g in rows], CHUNK)


def test_forms():
    assert forms.visual_form("ｆｕｌｌ ｗ​ｉｄｔｈ") == "full width"
    assert forms.visual_form("Сора") == "Copa" and forms.visual_form("ế") == "ế"
    assert forms.visual_form("Aa é") == "Aa é" and forms.canonical_form("STRASSE") == forms.canonical_form("straße")
    for t in ("", " \n\t", "a\r\nb ", "Ðiều", "tiếng Việt"):
        assert forms.visual_form(forms.visual_form(t)) == forms.visual_form(t)


def test_lookalike_pairs(spark):
    rows = [(1, "a", "d", 1, "Copa del rey", "es"), (2, "a", "d", 1, "Сора del rey", "es"), (2, "a", "d", 1, "Сора del rey", "es"), (3, "a", "d", 1, "copa del rey", "es"), (4, None, None, None, None, None), (5, "a", "d", 1, "Copa del rey", "es"), (6, "a", "d", 1, "  ", None)]
    got = forms.lookalike_pairs(chunks(spark, rows), "id", "text", 6).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 5)]
    assert forms.lookalike_pairs(chunks(spark, []), "id", "text").count() == 0
    assert forms.canonicalise(chunks(spark, rows), "text", "extra").where("id = 2").first()["extra"] == "copa del rey"


def test_forms_of_chunks_and_aliases(spark, tmp_path):
    chunks(spark, [(1, "a", "d", 1, "Сора del rey", "es"), (1, "a", "d", 1, "Сора del rey", "es"), (2, "a", "d", 1, None, None)]).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, ["Copa", "Сора"]), (3, None)], "concept_no bigint, aliases array<string>").write.parquet(f"{tmp_path}/banking_ontology.parquet")
    got = sorted(map(tuple, queries.p5_forms(spark, str(tmp_path)).collect()), key=str)
    assert got == [("banking_ontology", 1, "copa"), ("banking_ontology", 1, "copa"), ("chunks", 1, "copa del rey"), ("chunks", 2, None)]


def test_bpe_against_the_library():
    import tiktoken

    v = bpe.Ranks(bpe.rank_file())
    with open(bpe.rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\t\r's!ẫ1٣_.\x1c\x85　<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["a" * 3000 + "b" * 1001, "", "<|endoftext|>"]
    assert all(v.encode(t) == e.encode_ordinary(t) for t in texts) and v.encode(None) == []


def test_bpe_on_rows(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (3, "")], "doc_id bigint, text string")
    got = bpe.encode(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert sorted(map(tuple, bpe.count_tokens(df, "doc_id", "text").collect())) == [(1, 2), (2, 0), (3, 0), (3, 0)]


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, "Điều 1. A b.\n\nc d. " * 200, "中文。" * 900, "é" * 2000])
def test_pieces(text):
    out = pieces.cut_text(text, 700, 60)
    assert out[0][0] == 0 and out[-1][2] == len(text) and all(b - a <= 700 for a, _, b in out)
    for (_, _, b), (a, body, _) in zip(out, out[1:], strict=False):
        assert body == b and a == b - 60
    assert "".join(text[body:b] for _, body, b in out) == text
    assert pieces.cut_text("", 5, 2) == [(0, 0, 0)] and all(b - a <= 3 for a, _, b in pieces.cut_text("abcdefgh", 3, 9))


def test_tree_of_a_text():
    text = "# A\nintro\n\nChương I\nMục 1. x\nĐiều 1. y\nbody\n- one\n  - two\n- three\n\nnext\nĐiều 2. z"
    assert [(text[a:].split("\n")[0].strip(), r) for a, r in pieces.openers(text)] == [("# A", 1), ("intro", 20), ("Chương I", 7), ("Mục 1. x", 8), ("Điều 1. y", 9), ("body", 20), ("- one", 21), ("- two", 23), ("- three", 21), ("next", 20), ("Điều 2. z", 9)]
    articles = [f"Điều {i}. " + "chữ " * (5 + i % 3) for i in range(1, 30)]
    text = "\n".join(articles)
    out = pieces.cut_text(text, 120, 0)
    assert all(text[b:].startswith("Điều") for _, b, _ in out) and len(out) < 20  # siblings share a piece, none is broken
    text = "Điều 1. a\n" + "Khoản 1. " + "x " * 60 + "\nKhoản 2. y\nĐiều 2. b"
    assert [text[b:e].split(" ")[0] for _, b, e in pieces.cut_text(text, 140, 0)] == ["Điều", "Khoản"]
    assert pieces.overlap_of(100, 80) == 50


def test_pieces_on_rows(spark):
    limits = spark.createDataFrame([("vi", 20, 5), ("und", 10, 2)], "lang string, max_chars int, overlap_chars int")
    rows = [(1, "s", "d", 1, "một hai ba bốn năm sáu bảy", "vi"), (2, "s", "d", 1, "một hai ba", "vi"), (3, "s", "d", 1, "a" * 11, None), (3, "s", "d", 1, "a" * 11, None), (4, "s", "d", 1, None, "vi"), (5, "s", "d", 1, "b" * 11, "xx")]
    df = chunks(spark, rows)
    assert {r["id"] for r in pieces.cut_oversized(df, limits).where("piece_no > 1").collect()} == {1, 3, 5}
    numbers = sorted(r["chunk_on_page"] for r in pieces.recut_pages(df, limits).collect())
    assert numbers == list(range(1, len(numbers) + 1))
    with pytest.raises(ValueError):
        pieces.cut_oversized(df, limits.where("lang = 'vi'")).count()


def test_packing():
    r = random.Random(2)
    sizes = [int(min(3000, r.expovariate(1 / 300))) for _ in range(3000)] + [0, 0, 2048, 5000]
    bins, n = packing.pack(sizes, 2048)
    assert n == len(bins) and all(sum(x for *_, x in b) <= 2048 for b in bins)
    parts = {}
    for b in bins:
        for i, a, x in b:
            parts.setdefault(i, []).append((a, x))
    assert len(parts) == len(sizes)
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(x for _, x in p) == s and (len(p) == 1 or s > 2048)
        assert all(a + x == c for (a, x), (c, _) in zip(p, p[1:], strict=False))
    assert sum(sizes) / (n * 2048) > 0.95
    assert packing.pack([], 10) == ([], 0) and packing.pack([0, 0], 10)[1] == 1


def test_packing_on_rows(spark):
    items = spark.createDataFrame([(i, i % 7) for i in range(500)] + [(1, 3), (None, 2), (9, None)], "doc_id bigint, tokens bigint")
    packs = spark.createDataFrame([("p", 10)], "pack_name string, capacity_tokens int")
    out = packing.fill_containers(items, packs, "doc_id", "tokens", block=100)
    assert out.count() == 503 and out.groupBy("container_id").agg(F.sum("tokens").alias("t")).where("t > 10").count() == 0
    assert packing.fill_containers(items.limit(0), packs, "doc_id", "tokens").count() == 0


def test_repeated_lines(spark):
    notice, share = "All rights reserved by the office {}", "Share this page with all your friends"
    rows = [(i, "s", f"d{i}", 1, f"body number {'abcdefghij'[i]} stands quite alone here\n{notice.format(i)}\n{share}", "en") for i in range(8)]
    rows += [(20, "t", "e", 1, share, "en"), (21, "s", "d1", 2, None, "en"), (22, None, None, 1, share, "en"), (0, "s", "d0", 1, rows[0][4], "en")]
    df = chunks(spark, rows)
    got = sorted(map(tuple, repeated.repeated_lines(df).select("id", "line_no").collect()))
    assert got == sorted((i, k) for i in range(8) for k in (2, 3))
    assert [(r["source"], r["lines"], r["documents"]) for r in repeated.block_report(df).collect()] == [("s", 2, 8)]
    clean = {r["id"]: r["clean_text"] for r in repeated.strip_repeated(df).collect()}
    assert clean[3].count("\n") == 0 and clean[20] == share and clean[21] is None and len(clean) == 11
    assert repeated.repeated_lines(chunks(spark, [])).count() == 0 and repeated.block_report(chunks(spark, [])).count() == 0


def test_repeated_blocks_against_brute_force(spark):
    r = random.Random(8)
    pool = [f"{w} line of the notice that all of them share" for w in ("first", "second", "third", "fourth", "fifth", "sixth", "seventh")]
    texts = []
    for i in range(30):
        a, b = sorted(r.sample(range(8), 2))
        texts.append([*pool[a:b], f"body of its own {'abcdefghijklmnopqrstuvwxyzäöüß'[i]} stands here", *r.choices(pool, k=r.randint(0, 3))])
    df = chunks(spark, [(i, "s", f"d{i // 2}", 1, "\n".join(t), "en") for i, t in enumerate(texts)])

    def documents(block):
        return len({i // 2 for i, t in enumerate(texts) if any(t[k : k + len(block)] == block for k in range(len(t)))})

    want = set()
    for i, t in enumerate(texts):
        end = 0
        for a in range(len(t)):
            n = max((n for n in range(len(t) - a + 1) if not n or documents(t[a : a + n]) >= 4), default=0)
            if n and a + n > end:
                want.add((i, a + 1, n))
            end = max(end, a + n)
    got = repeated.repeated_blocks(df).collect()
    assert {(x["id"], x["start"], x["lines"]) for x in got} == want and max(n for *_, n in want) > 4
    assert len({x["block"] for x in got}) == len({tuple(texts[i][a - 1 : a - 1 + n]) for i, a, n in want})


def test_quality():
    common = set("the bank must keep a record of each loan and report it to board within".split())
    judge = lambda t: quality.judge(t, quality.statistics(t, common), t)[0]
    prose = "The bank must keep a record of each loan. It must report it to the board within 5 days, and keep it. " * 3
    assert judge(prose) is None and judge("1. The bank must keep a record.\n2. The board must report it.\n3. Each loan of the bank.\n4. Keep it.") is None
    assert judge("\n".join(f"{i}) the loan record of bank" for i in range(8))) == "list"
    assert judge(", ".join(["the loan record of the bank"] * 3 + ["a board report", "each loan"] * 6)) == "list"
    assert judge("\n".join(f"loan {i}\t12.5\t{i}00\t3/4/2020" for i in "abcdef")) == "table"
    assert judge("a8Fk+/9" * 60) == "junk" and judge("#&* ~~ ¤¤ <> " * 30) == "junk"
    assert judge("NgÆ°á»\u009di Ä\u0091á»©ng Ä\u0091áº§u quyáº¿t Ä\u0091á»\u008bnh viá»\u0087c") == "junk"
    assert judge("the bank " * 400) == "junk"


def test_quality_on_rows(spark):
    rows = [(1, "s", "d", 1, None, "en"), (2, "s", "d", 1, " \n", "en"), (3, "s", "d", 1, "Some words stand here.", "en"), (3, "s", "d", 1, "Some words stand here.", "en")]
    got = {r["id"]: r for r in quality.judged(chunks(spark, rows)).collect()}
    assert got[1]["words"] is None and got[2]["kind"] is None and got[3]["words"] == 4 and len(got) == 3


def test_sentences():
    model = (frozenset({"v.v", "tp", "dr", "etc", "no", "cf"}), frozenset({"the", "khách"}), {"etc": {"and"}, "v.v": {"và"}})

    def cut(t):
        at = sentences.sentence_starts(t, model)
        return [t[a:b].strip() for a, b in zip(at, [*at[1:], len(t)], strict=False)]

    assert cut("He met Dr. Lund at 5.30. Then he left!") == ["He met Dr. Lund at 5.30.", "Then he left!"]
    assert cut("Loans, etc. and a copy. Cards, etc. The end.") == ["Loans, etc. and a copy.", "Cards, etc.", "The end."]
    assert cut("He said “It is void. Nobody may go.” before noon. Then") == ["He said “It is void. Nobody may go.” before noon.", "Then"]
    assert cut("Section 5. Custody of loans\n\nA line\nbreak.") == ["Section 5. Custody of loans", "A line\nbreak."]
    assert cut("“谁去？”会议问。好！") == ["“谁去？”会议问。", "好！"]
    assert cut("ลูกค้าขอ ให้ธนาคาร 75 วัน") == ["ลูกค้าขอ", "ให้ธนาคาร 75 วัน"]
    assert cut("") == [] and cut(" \n ") == [] and cut("no end") == ["no end"]


def test_sentences_on_rows(spark):
    rows = [(i, "s", "d", 1, f"Mr. Lund came to ask. Did he ask and ask and ask there and there and there? The clerk of Mr. Olsen was there. It was {i}.", "en") for i in range(20)] + [(90, "s", "d", 1, None, None)]
    df = chunks(spark, rows)
    models = sentences.learn(sentences.statistics(df, "text", "lang"))
    out = sentences.split_sentences(df.where("id in (0, 90)"), models)
    text = rows[0][4]
    assert sorted(r["start_pos"] for r in out.collect()) == [1, *(text.index(x) + 1 for x in ("Did", "The clerk", "It was"))]


def test_scan_noise(spark):
    body = "the customer must keep the original passbook at the counter of the branch office today"
    rows = [(i, "s", f"d{i % 9}", i % 5 + 1, (body + ".\n") * 4, "en") for i in range(40)]
    rows += [(100, "s", "dx", 1, f"Lund — Custody of the loan\n{body}.\nthe pass-\nbook of the cust0mer\n- 1 -", "en"), (101, "s", "dx", 2, f"Lund — Custody of thc loan   2\n{body}.", "en"), (102, "s", "dx", 3, f"{body}.\na follow-\nup letter", "en"), (103, "s", "dx", 4, None, "en")]
    rows += [(200 + i, "s", f"f{i}", 1, f"{body} and a follow-up", "en") for i in range(5)]
    got = {tuple(r) for r in scans.noise(chunks(spark, rows)).collect()}
    assert {(100, "header"), (100, "hyphen"), (100, "misread"), (100, "page_no"), (101, "header")} <= got
    assert not {k for i, k in got if i == 102} and not any(i < 100 for i, _ in got)


def test_scan_repair(spark):
    body = "the customer must keep the original passbook at the counter of the branch office today"
    rows = [(i, "s", f"d{i % 9}", i % 5 + 1, (body + ".\n") * 4, "en") for i in range(40)]
    rows += [(100, "s", "dx", 1, f"Lund — Custody of the loan\n{body}.\nthe pass-\nbook, of the Cust0mer\n\nis a follow-\nup pass-\nPage 1\nbook\n1. item", "en"), (101, "s", "dx", 2, f"Lund — Custody of thc loan   2\n{body}.", "en"), (103, "s", "dx", 4, None, "en"), (104, "s", "dx", 5, "一二\n三四", "zh"), (104, "s", "dx", 5, "一二\n三四", "zh")]
    rows += [(200 + i, "s", f"f{i}", 1, f"{body} and a follow-up", "en") for i in range(5)]
    out = scans.paragraphs(chunks(spark, rows)).collect()
    got = {r["id"]: r["text"] for r in out}
    assert len(out) == len(got) == 49 and got[0] == " ".join([body + "."] * 4)
    assert got[100] == f"{body}. the passbook, of the Customer\n\nis a follow-up passbook\n\n1. item"
    assert got[101] == f"{body}." and got[103] is None and got[104] == "一二三四"


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(12):
        base = [r.choice(words) for _ in range(120)]
        for k in range(4):
            x = list(base)
            for _ in range(k * 3):
                x[r.randrange(len(x))] = r.choice(words)
            texts[g * 10 + k] = " ".join(x)
    texts[500] = texts[0]
    want = set()
    sets = {i: set(neardup.shingles(neardup.word_list(t)).tolist()) for i, t in texts.items()}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                want.add((a, b))
    rows = [(i, "s", "d", 1, t, "en") for i, t in texts.items()] + [(0, "s", "d", 1, texts[0], "en"), (900, "s", "d", 1, None, "en"), (901, "s", "d", 1, "short", "en")]
    df = chunks(spark, rows)
    got = {tuple(x) for x in neardup.similar_pairs(df, "id", "text").collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    groups = {x["id"]: x["group_id"] for x in neardup.similar_groups(df, "id", "text").collect()}
    assert groups[500] == groups[0] == 0 and len(groups) == len(texts)


def test_near_duplicate_tables_leave_the_disk(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(30):
        base = [r.choice(words) for _ in range(80)]
        texts |= {g * 10: " ".join(base), g * 10 + 1: " ".join([*base[:-3], "x", "y", "z"]), g * 10 + 2: " ".join(["a", *base])}
    df = chunks(spark, [(i, "s", "d", 1, x, "en") for i, x in texts.items()] + [(0, "s", "d", 1, texts[0], "en")])
    monkeypatch.setattr("tessella.session.shared_dir", lambda s: str(tmp_path))
    try:
        links, members = neardup.similar_classes(df, "id", "text", pairs_at_once=7)
        # of all tables, those of what comes back are left, members and links by slices, and the keys of once()
        kept = {f.rsplit("/", 2)[-2] for f in links.inputFiles() + members.inputFiles()}
        assert kept < {p.name for p in tmp_path.iterdir()} and len(list(tmp_path.iterdir())) == len(kept) + 1
        assert len(links.inputFiles()) > 1  # slices
        assert {(x["rep_a"], x["rep_b"]) for x in links.collect()} == {(g * 10 + a, g * 10 + b) for g in range(30) for a, b in ((0, 1), (0, 2), (1, 2))}
        # an anchor that goes on over batches; rows given twice
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        at = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (2, 6), (2, 7), (2, 8), (3, 1), (4, 9), (4, 10)], "anchor bigint, rep bigint")
        assert sorted(map(tuple, neardup._repeated(at).collect())) == [(2, 5), (2, 6), (2, 7), (2, 8), (4, 9), (4, 10)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_anchors_are_shuffled_packed_and_alone(spark, monkeypatch, tmp_path):
    # lists of a word a mask; equal words under unlike masks are unlike anchors, a record given twice is one
    lists = [("a", [1, -2]), ("b", [5, 1]), ("c", [1, 7]), ("c", [1, 7]), ("d", [8, 7]), ("e", [9, 9]), ("e", [9, 9])]
    at = spark.createDataFrame(lists, "rep string, anchor array<int>")
    for parts in (1, 3):
        got = neardup._repeated(at, parts)
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "c"), ((1 << 32) + 7, "c"), ((1 << 32) + 7, "d")]
        plan = got._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
        assert "Sort" not in plan and plan.count("Exchange") == 1
    assert neardup._repeated(at.limit(0)).collect() == []
    # what is shuffled by anchor has no sketches; pairs whose sizes rule the similarity out are not met
    monkeypatch.setattr("tessella.session.shared_dir", lambda s: str(tmp_path))
    r = random.Random(9)
    long = [f"w{r.randrange(300)}" for _ in range(260)]
    df = chunks(spark, [(1, "s", "d", 1, " ".join(long), "en"), (2, "s", "d", 1, " ".join(long[:120]), "en"), (3, "s", "d", 1, " ".join(long[:250]), "en")])
    seen, real = [], neardup._repeated
    monkeypatch.setattr(neardup, "_repeated", lambda x, *a: (seen.append(x.columns), real(x, *a))[1])
    prints = neardup.fingerprints(df, "id", "text").withColumnRenamed("id", "_id")
    met = neardup._meeting(prints, prints.select("_id").limit(0), "anchors0", 3, neardup.LEAST)
    assert [sorted(x) for x in seen] == [["anchor", "rep"]] and sorted(map(tuple, met.collect())) == [(1, 3)]


def test_pairs_at_one_half_are_met(spark):
    # 400 pairs of 300 triples, 200 shared, so each is at just 0.5
    r = np.random.default_rng(4)
    a = neardup._coefficients(neardup.SYMBOLS)
    lost = 0
    for _ in range(4000):
        h = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        (x, p), (y, q) = (neardup.anchors(np.sort(s), a, neardup.ROWS) for s in (h[:300], h[100:]))
        lost += not (x == y).any() or sum(int(z).bit_count() for z in p ^ q) > neardup.FAR
    # 1e-4 of the pairs are lost by design, so 0.4 are expected; ten times as many would be 4
    assert lost <= 2


def test_connected_runs_until_nothing_changes(spark):
    path = list(range(1, 301))
    random.Random(6).shuffle(path)
    pairs = [*zip(path, path[1:], strict=False), (500, 501)]
    got = {r["u"]: r["g"] for r in neardup.connected(spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u bigint, v bigint")).collect()}
    assert got == dict.fromkeys(path, 1) | {500: 500, 501: 500}


def test_block_max_search_is_exact():
    r = random.Random(3)
    rows = [[r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(12)] for _ in range(700)]
    ix = abuse.BlockMaxIndex(rows)
    for q in rows[:20]:
        ids, v = ix.vector(q)
        dense = np.zeros(ix.n)
        for i, y in zip(ids, v, strict=True):
            a, b = ix.start[i], ix.start[i + 1]
            dense[ix.docs[a:b]] += y * ix.weights[a:b]
        want = sorted(dense, reverse=True)[:10]
        assert np.allclose([s for s, _ in ix.search(ids, v, 10, 0.05)], want, atol=1e-5)


def test_abuse_scores(spark):
    good = ["The fee of the loan is {} too high for us.", "I waited {} days at the counter of the bank.", "Many thanks to the clerk {} for help."]
    bad = ["Shut up {}, you worthless m0ron of a clerk.", "I will smash your face {} tomorrow."]
    rows = [(i, " ".join(good[k].format(f"n{i}") for k in range(3)), "s") for i in range(60)] + [(100 + i, good[i % 3].format(f"n{i}") + " " + bad[i % 2].format(f"n{i}"), "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 0, 0) for i in range(50)] + [(100 + i, 0, 1) for i in range(15)] + [(7, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (300, None, None), (301, "", "s"), (302, "SHUT UP Ann, you worthless mooooron of a clerk!", "s")], "doc_id bigint, text string, source string")
    model = abuse.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in abuse.scored(docs, model).collect()}
    assert len(got) == docs.count() and got[300] == got[301] == 0
    assert all(got[i] < abuse.LEAST_SHARE for i in range(60)) and all(got[i] >= abuse.LEAST_SHARE for i in (115, 116, 117, 118, 119, 302))
    assert abuse.rates(docs, abuse.scored(docs, model)).where("source = 's'").first()["documents"] == 82
    empty = abuse.learn(docs, labels.limit(0))
    assert empty.score(empty.numbers(("a",))) == (0.0, -1) and empty.scores(["a b", None]) == [(0.0, None, None)] * 2
    # no sentence that the bounds rule out has a score, and vectors by number are those by word
    for _, t, _ in rows:
        left = {k for _, k, _ in model.within_bounds([t])}
        for k, (_, ts) in enumerate(abuse.sentences(t)):
            assert k in left or model.score(model.numbers(ts))[0] == 0
            ids, v = model.index.vector(abuse.grams(ts))
            a, b = model._vector(np.array(model.numbers(ts)))
            assert dict(zip(a.tolist(), b.tolist(), strict=True)) == pytest.approx(dict(zip(ids, v, strict=True)))


def test_page_lines():
    assert [scans.roman(x) for x in ("i", "iv", "IX", "xii", "xlii", "xc")] == [1, 4, 9, 12, 42, 90]
    assert scans.is_page_line("iv", 4) and scans.is_page_line("XII", 12) and not scans.is_page_line("iv", 5) and not scans.is_page_line("ix", None)
    assert scans.is_page_line("- 7 -", 1) and scans.is_page_line("7", 7) and not scans.is_page_line("7", 8) and not scans.is_page_line("mix", 1009)


def test_batch_statistics_equal_those_of_one_text():
    common = set("the bank must keep a record of each loan and report it to board within".split())
    texts = ["The bank must keep a record of each loan. It must report it to the board within 5 days, and keep it. " * 3, "- one\n- two\n3) three\nfour …", "中文。中文。", "#&* ~~ <> " * 30, "a\tb; c\n1\t2; 3", "The bank must.", "thai ภาษาไทย", "a8Fk+/9" * 60]
    s = quality.batch_statistics(pa.array(texts), pa.array(sorted(common)))
    sure = quality.surely_prose(pa.array(texts), pa.array(texts), s)
    for i, t in enumerate(texts):
        one = quality.statistics(t, common)
        assert s["words"][i] == one["words"] and s["symbols"][i] == pytest.approx(one["symbols"]) and s["mean_word"][i] == pytest.approx(one["mean_word"])
        assert s["common"][i] == pytest.approx(one["common"]) and s["closed_lines"][i] == pytest.approx(one["closed_lines"]) and s["ends"][i] <= one["ends"]
        assert not sure[i] or quality.judge(t, one, t)[0] is None
    broken = quality.failures(s)
    assert sure[0] and broken[0] == [] and {"few_words", "short_words", "ellipses"} - set(broken[1]) <= {"ellipses", "short_words"} and "signs" in broken[3]
    assert s["bullet_lines"][1] == 0.75 and s["ellipsis_lines"][1] == 0.25
