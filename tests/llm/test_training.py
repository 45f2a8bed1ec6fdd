"""The training-text operators against brute force, round trips and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm import boost, bpe, distinctive, leakage, names, noise, reading, sentences, splitting, works

TEXTS = [None, "", " ", "Hello  world\n\n it's 42!!", "<|endoftext|> is text", "école ção 日本語のテキスト ไทย", "a" * 5000, "x \t\n  y", "word " * 3000, "ẞ\U0001fae8 odd ", "Hello  world\n\n it's 42!!"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("words", F.lit(1))


def test_encoding(spark, docs):
    e = bpe.encoder(bpe.RANKS)
    true = {i: e.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    for most in ((bpe.BLOCK_WORDS, bpe.BLOCK_TOKENS), (5, 20), (1, 1)):  # one block a partition, a few, one a text
        got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(docs, block_words=most[0], block_tokens=most[1]).collect()}
        assert got == true
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_corpus(docs.limit(0)).count() == 0
    assert bpe.decode_corpus(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]


def test_encoding_of_repeated_keys(spark):
    e = bpe.encoder(bpe.RANKS)
    rows = [(1, "one text of a key"), (1, "and another text"), (1, "one text of a key"), (None, "no key here"), (None, None)]
    for most in (bpe.BLOCK_WORDS, 1):
        got = sorted(((r.doc_id or 0, list(r.ids)) for r in bpe.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string"), block_words=most).collect()))
        assert got == sorted((i or 0, e.encode_ordinary(t) if t else []) for i, t in rows)


def test_doubling_is_walking():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 200):
        nxt = np.minimum(np.arange(n) + rng.integers(0, 5, n), n - 1)
        reached, i = {0}, 0
        while nxt[i] != i:
            i = nxt[i]
            reached.add(int(i))
        assert set(np.flatnonzero(splitting.doubling(nxt, np.array([0])))) == reached


def test_splitting(spark, docs):
    e = bpe.encoder(bpe.RANKS)
    got = splitting.split_corpus(docs, limit=50, overlap=10).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(TEXTS):
        own = [r for r in got if r.doc_id == i]
        if not text:
            assert not own
            continue
        assert own[0].start_pos == 1 and own[-1].end_pos == len(text)
        for a, b in zip(own, own[1:]):
            assert a.start_pos < b.start_pos <= a.end_pos + 1 and a.end_token < b.end_token and a.end_token - b.start_token <= 24
            # the overlap is at least what was asked for, or the next piece could not go on
            assert a.end_token - b.start_token >= 10 or i == 6
        for r in own:
            assert r.n_tokens <= 50 and r.piece_text == text[r.start_pos - 1 : r.end_pos] and r.n_pieces == len(own)
    assert {r.doc_id for r in splitting.oversized(docs, limit=50, overlap=10).collect()} == {i for i, t in enumerate(TEXTS) if t and len(e.encode_ordinary(t)) > 50}


def test_leaks(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(40)]
    other = [word() for _ in range(40)]
    noisy = passage[:25]
    noisy[7] = "changed"
    rows = [
        (1, "Start. " + " ".join(noisy).upper().replace(" ", ",\n") + " end."), (2, " ".join(passage[:15]) + " and no more"), (3, " ".join(word() for _ in range(100))), (4, None), (5, ""),
        (6, "{{t|" + " ".join(passage[10:24]) + " [[inserted link here|" + passage[24] + "]] " + " ".join(passage[25:38]) + "}}"), (7, " ".join(word() for _ in range(20000)) + " ".join(passage)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, " ".join(passage)), (11, " ".join(other)), (12, None), (13, "too short")], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs.drop("item_id"), items).collect()}
    assert got == {(1, 10), (6, 10), (7, 10)}
    assert leakage.leaks(docs.drop("item_id"), items.limit(0)).count() == 0
    found = leakage.leaks(docs.drop("item_id"), items)
    assert {r.doc_id for r in leakage.without_leaks(docs, found).collect()} == {2, 3, 4, 5}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs.drop("item_id"), items, block_words=50).collect()} == got
    clean = {r.doc_id: r for r in leakage.without_spans(docs, found).collect()}
    assert clean[1].text == "Start.  end." and clean[2].text == rows[1][1] and clean[4].text is None and clean[6].text == "{{t|}}"
    assert [clean[i].n_spans for i in (1, 2, 4, 5)] == [1, 0, 0, 0] and clean[7].text == rows[6][1][: -len(" ".join(passage[1:]))]


def test_leaks_need_the_passage_itself(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(40)]
    # three runs of four words with foreign ones between span most of it, but hold 12 of 40 words
    scattered = [w if i in (0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23) else word() for i, w in enumerate(passage)]
    # single words exchanged close to each other
    changed = [word() if i in (3, 6, 9, 15) else w for i, w in enumerate(passage[:24])]
    docs = spark.createDataFrame([(1, " ".join(scattered)), (2, " ".join(changed)), (3, "it is Brief Text here"), (4, "brief it text")], "doc_id long, text string")
    # more distinct words than a product of four fits 64 bits
    items = [(10, " ".join(passage)), (11, "brief, text"), *[(100 + i, " ".join(word() for _ in range(60))) for i in range(1100)]]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert got == {(2, 10), (3, 11)}


@pytest.mark.parametrize(
    "text, units",
    [
        ("Dr. Smith met J. K. Jones at 4 p.m. in St. Ives. It rained.", ["Dr. Smith met J. K. Jones at 4 p.m. in St. Ives.", "It rained."]),
        ("Sampling began at 4 p.m. The season ended.", ["Sampling began at 4 p.m.", "The season ended."]),
        ("It rose by 3.5 percent (cf. Fig. 2.7) here. (See Tab. 3.) End.", ["It rose by 3.5 percent (cf. Fig. 2.7) here.", "(See Tab. 3.)", "End."]),
        ('"Is it open?" asked Ann. He wrote "It failed. We stopped." in it.', ['"Is it open?" asked Ann.', 'He wrote "It failed. We stopped." in it.']),
        ("The keeper said, “It is lost?” Then all went.", ["The keeper said, “It is lost?”", "Then all went."]),
        ("Elle a écrit « Le pont. La gare. » chaque année. Fin !", ["Elle a écrit « Le pont. La gare. » chaque année.", "Fin !"]),
        ("港は毎年道を変えた。市場は「橋。駅。」と書いた。畑だ！？", ["港は毎年道を変えた。", "市場は「橋。駅。」と書いた。", "畑だ！？"]),
        ("यह गाँव है। वह नदी है?", ["यह गाँव है।", "वह नदी है?"]),
        ("Am 25. März endete es. Gut.", ["Am 25. März endete es.", "Gut."]),
        ("The archive\n- 38 -\nopened near St.\nPage 4 of 9\nIves now. mRNA fell.", ["The archive\n- 38 -\nopened near St.\nPage 4 of 9\nIves now.", "mRNA fell."]),
        ("It faded ... and then won. No stop", ["It faded ... and then won.", "No stop"]),
        ("One ended.Two began.", ["One ended.", "Two began."]),
        (" ", []),
        ("", []),
    ],
)
def test_sentence_units(text, units):
    gaps = sentences.Gaps({}, {})
    assert [text[s - 1 : e] for s, e in sentences.units(text, gaps)] == units


def test_thai_gaps(spark):
    rows = [(i, f"พิพิธภัณฑ์เปลี่ยนหุบเขา{x}ทุกปี หมู่บ้านนี้ข้ามสถานี{x}ในฤดูหนาว") for i, x in enumerate("กขคงจ")] + [(20 + i, f"หมู่บ้านนี้ข้ามสถานี{x}ในฤดูหนาว พิพิธภัณฑ์เปลี่ยนหุบเขา{x}ทุกปี") for i, x in enumerate("กขคงจ")] + [(9, "พิพิธภัณฑ์\n12\nเปลี่ยนทุกปี"), (10, None), (10, None)]
    df = spark.createDataFrame(rows, "sentence_id long, text string").withColumn("start_pos", F.lit(1))
    got = sentences.sentence_units(df).collect()
    assert len([r for r in got if r.sentence_id == 0]) == 2 and len([r for r in got if r.sentence_id == 9]) == 1


def test_gaps_of_other_scripts(spark):
    # a final particle before and an opening word after the gap, both learned
    rows = [(i, f"港は{x}毎年道を変えた。") for i, x in enumerate("一二三四五六七")] + [(20 + i, f"市場は{x}橋を守った。") for i, x in enumerate("一二三四五六七")]
    rows += [(90, "港は八毎年道を変えた 市場は九橋を守った。"), (91, "港は八毎年\n道を変えた。"), (92, "ບ້ານ" * 400 + " " + "ບ້ານ" * 400)]
    got = {}
    for r in sentences.sentence_units(spark.createDataFrame(rows, "sentence_id long, text string")).collect():
        got.setdefault(r.sentence_id, []).append((r.start_pos, r.end_pos))
    assert len(got[90]) == 2 and len(got[91]) == 1 and len(got[0]) == 1


def test_two_poisson(spark):
    rows = [(p, "S", t, n) for p in range(60) for t, n in (("Data", 8), ("data ", 1), (f"own {p}", 12), (f"other {p % 3}", 1))] + [(0, "S", None, 3), (0, "S", " ", 3), (1, None, "x", 2), (0, "S", "own 0", 12)]
    df = spark.createDataFrame(rows, "paper_id long, section string, ngram string, n int").withColumn("weight", F.lit(1))
    got = {(r.paper_id, r.section): r for r in distinctive.most_characteristic(df, ["paper_id", "section"], k=1).collect()}
    assert all(got[(p, "S")].term == f"own {p}" for p in range(60)) and got[(1, None)].term == "x"
    assert distinctive.scores(df, ["paper_id", "section"]).where("paper_id = 3 and term = 'data'").first().n == 9
    assert distinctive.scores(df.limit(0), ["paper_id", "section"]).count() == 0


def test_reading_levels(spark):
    easy, mid, hard = "The cat sat on the mat. It was a dog. They ran to it. ", "In the early season the market was opened and the old cart was sold to the festival near the border. ", "The institutional reconstruction of administrative methodology substantiated considerable categorization of the infrastructure, notwithstanding comparative heterogeneity of the documentation and industrialization. "
    rows = [(i, t * 12) for i, t in enumerate([easy, mid, hard] * 6)] + [(100, None), (101, ""), (102, "Der Hund und die Katze. " * 30), (103, easy), (104, "{{Infobox\n| a = b\n}}\n" + easy * 12 + "<ref>Open one\n\n* list the of and to\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("reading_level", F.lit("x"))
    stored = spark.createDataFrame([], "doc_id long, flesch_kincaid_grade double, flesch_reading_ease double, n_sentences int, n_words int, n_syllables int, computed_at timestamp")
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs.drop("reading_level"), stored).collect()}
    assert got == {i: reading.LEVELS[i % 3] for i in range(18)} | {104: "basic"}


def test_names(spark):
    a = [(1, "Elizabeth", "Zolitowick"), (2, "Beth", "ZOLITOWICK"), (3, "E.", "Zolitowikc"), (4, None, "Zolitowick, Elizabeth"), (5, "Henry", "Zolitowick"), (6, "Zolitowick", "Elizabeth"), (7, None, "Centre of River Engineering, Raron"), (8, None, "Raron Centre for River Eng."), (9, None, None), (10, "Oliver", "de la Mennar-Stufeitan"), (11, "Olli", "Delamennar-Stufeitan"), (5, "Henry", "Zolitowick")]
    authors = spark.createDataFrame([(i, g, f, None) for i, g, f in a], "author_id long, given_name string, family_name string, orcid string").withColumn("n", F.lit(1))
    cites = spark.createDataFrame([(50, "Zolitowick", "Zolitowick, H., Brown, J."), (51, "Zolitowick", None), (52, "Zolitowick", "B. Smith")], "mapping_id long, cite_author string, ref_authors string")
    got = {(r.rec_a, r.rec_b) for r in names.linked(names.entities(authors, cites)).collect()}
    assert {(1, 2), (1, 4), (1, 6), (2, 4), (7, 8), (10, 11), (5, 50), (1, 3)} <= got
    assert not {(1, 5), (1, 50), (1, 7), (5, 6), (1, 9)} & got
    assert names.entities(authors.limit(0), cites.limit(0)).count() == 0
    n = {(r.rec_id, r.is_author): r.n_links for r in names.sizes(names.entities(authors, cites)).collect()}
    assert all(n[(i, True)] == sum(i in p for p in got) for i in (1, 2, 5, 7)) and n[(50, False)] == sum(50 in p for p in got)


def test_names_of_several_and_exchanged_with_particles(spark):
    given = names.Given(["henry", "oliver", "de"])
    assert given.formal("kit") == ("christopher", "katherine") and given.formal("xqzt") == () and given.formal("olivr") == ("oliver",)
    assert names.parse("Henry", "de la Leitheil", given) == names.parse("de la Leitheil", "Henry", given)
    assert names.parse("Olivre", "Zamborin", given)[1] in ("oliver", "zamborin")
    a = [(1, "Edward", "Primoulil"), (2, "Ted", "Primoulil"), (3, "Theodore", "Zandovik"), (4, "Ted", "Zandovik"), (5, "Kit", "Primoulil")]
    authors = spark.createDataFrame([(i, g, f, None) for i, g, f in a], "author_id long, given_name string, family_name string, orcid string")
    cites = spark.createDataFrame([], "mapping_id long, cite_author string, ref_authors string")
    assert {(r.rec_a, r.rec_b) for r in names.linked(names.entities(authors, cites)).collect()} == {(1, 2), (3, 4)}


def test_names_refused_by_the_leader(spark):
    # both differ from the largest spelling by two slips and from each other by one; short names by their spelling
    a = [(i, "Henry", "Mannorfeld") for i in range(5)] + [(10, "Henry", "Mannofelds"), (11, "Henry", "Mannofeld")] + [(20, "Oliver", "Wu"), (21, "O.", "Wu"), (22, "Oliver", "Li")]
    authors = spark.createDataFrame([(i, g, f, None) for i, g, f in a], "author_id long, given_name string, family_name string, orcid string")
    cites = spark.createDataFrame([], "mapping_id long, cite_author string, ref_authors string")
    got = {(r.rec_a, r.rec_b) for r in names.linked(names.entities(authors, cites)).collect()}
    assert (10, 11) in got and (20, 21) in got and (20, 22) not in got


def test_components_are_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    got = {r.a: r.root for r in names.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[x] == find(x) for x in {v for e in edges if e[0] != e[1] for v in e})


def test_works(spark):
    c = [(1, "Smith, J., Brown, K. (2001). Notes on local market organization in Graneberg. Journal of River Engineering, 5, 10-20."), (2, "[3] J. Smith & K. Brown. Notes on local market organization in Graneberg. J. River Eng. vol. 5, 2001"), (3, "Smith, J. (2001). Notes on local market organization in Graneberg. Reply. J. River Eng., 6, 30-31."), (4, "Smith, J. (2001). Notes on local market organization in Zulwick. J. River Eng., 9, 3-4."), (5, None), (6, ""), (7, "no reference at all"), (1, "Smith, J., Brown, K. (2001). Notes on local market organization in Graneberg. Journal of River Engineering, 5, 10-20.")]
    cites = spark.createDataFrame(c, "mapping_id long, ref_full_text string").withColumn("confidence", F.lit(1))
    r = [(10, "Notes on local market organisation in Granebreg", '[{"family": "Smith"}]', "2001", "J. River Eng.", "5", "10", None), (11, "Notes on local market organization in Graneberg: reply", "Smith J", "2001", None, "6", None, None), (12, "Notes on local market organization in Zulwick", "Smith J", "2001", "Journal of River Engineering", "9", None, None), (13, None, None, None, None, None, None, None)]
    refs = spark.createDataFrame(r, "ref_row_id long, article_title string, author string, ref_year string, journal string, volume string, first_page string, ref_full string")
    got = {(x.mapping_id, x.ref_row_id) for x in works.match(cites, refs).collect()}
    assert got == {(1, 10), (2, 10), (3, 11), (4, 12)}
    assert works.match(cites.limit(0), refs).count() == 0


def test_works_misread_at_place_and_author(spark):
    # place misread at both ends, author at the first letter; others sort between
    cites = spark.createDataFrame([(1, "Bmithson, J. (1984). Survey of narrow timber precipitation in Craneberq. Journal of River Engineering, 57, 310-320.")], "mapping_id long, ref_full_text string")
    r = [(10, "Survey of narrow timber precipitation in Graneberg", "Smithson J", "1984", "Journal of River Engineering", "57", "310", None)]
    r += [(100 + i, f"Notes on {w} regular council accounting in E{w}n", "Miller K", str(1900 + i), "Journal of River Engineering", str(i), "10", None) for i, w in enumerate("".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 9, 5)) for i in range(40))]
    refs = spark.createDataFrame(r, "ref_row_id long, article_title string, author string, ref_year string, journal string, volume string, first_page string, ref_full string")
    assert {(x.mapping_id, x.ref_row_id) for x in works.match(cites, refs).collect()} == {(1, 10)}


def test_works_sharing_word_starts(spark):
    # one place and equal word starts, or no place and one title, are not yet one work
    cites = spark.createDataFrame([(1, "Smith, J. (1950). Notes on public railway reconstruction in Graneberg. Journal of River Engineering, 5, 10-20."), (2, "Olsson, K. (1990). Survey of private raising recovery in Graneberg. Annals of Soil Science, 61, 300-310.")], "mapping_id long, ref_full_text string")
    r = [(10, "Notes on public railway reconstruction in Graneberg", "Smith J", "1950", "Journal of River Engineering", "5", "10", None), (11, "Survey of private raising recovery in Graneberg", "Olsson K", "1990", "Annals of Soil Science", "61", "300", None)]
    fields = "ref_row_id long, article_title string, author string, ref_year string, journal string, volume string, first_page string, ref_full string"
    assert {(x.mapping_id, x.ref_row_id) for x in works.match(cites, spark.createDataFrame(r, fields)).collect()} == {(1, 10), (2, 11)}
    bare = [(i, "Notes on public railway reconstruction", f"{a} J", y, None, v, None, None) for i, a, y, v in ((20, "Smith", "1950", "5"), (21, "Olsson", "1990", "61"), (22, "Smith", "1950", "5"))]
    assert works.nodes_of(works.read_references(spark.createDataFrame(bare, fields)))[1].count() == 2


def test_works_titles_without_a_place(spark):
    # three works whose titles end alike, without ' in ', are three pairs and not nine
    known = [("Ahlgren", "Robust training of recurrent neural networks", "Annals of Soil Science", "1988", "12", "101"), ("Botha", "Pruning and compression of spiking neural networks", "Journal of River Engineering", "2004", "31", "77"), ("Cerny", "A short history of artificial neural networks", "Letters on Cave Biology", "2017", "58", "412")]
    cites = spark.createDataFrame([(i, f"{a}, J. ({y}). {t}. {j}, {v}, {p}-{int(p) + 9}.") for i, (a, t, j, y, v, p) in enumerate(known)], "mapping_id long, ref_full_text string")
    refs = spark.createDataFrame([(10 + i, t, f"{a} J", y, j, v, p, None) for i, (a, t, j, y, v, p) in enumerate(known)], "ref_row_id long, article_title string, author string, ref_year string, journal string, volume string, first_page string, ref_full string")
    assert {(x.mapping_id, x.ref_row_id) for x in works.match(cites, refs).collect()} == {(0, 10), (1, 11), (2, 12)}
    assert {(x.source, x.id) for x in works.work_members(cites, refs).collect()} == {("c", i) for i in range(3)} | {("r", 10 + i) for i in range(3)}


def test_assignment_has_the_largest_total(spark):
    import itertools

    rng = random.Random(4)
    for trial in range(3):
        value = {(i, 100 + j): round(0.8 + 0.2 * rng.random(), 3) for i in range(5) for j in range(5) if rng.random() < 0.6}
        best = max(sum(value.get((i, 100 + j), 0) for i, j in enumerate(p)) for p in itertools.permutations(range(5)))
        pairs = spark.createDataFrame([(a, b, v, 1) for (a, b), v in value.items()], "a long, b long, confidence double, support long")
        exact = works.assigned(pairs).collect()
        assert len({r.a for r in exact}) == len(exact) == len({r.b for r in exact}) and abs(sum(r.confidence for r in exact) - best) < 1e-4
        if trial == 0:  # the way for components of any size
            bid = works.assigned(pairs, exact=1).collect()
            assert len({r.a for r in bid}) == len(bid) == len({r.b for r in bid}) and sum(r.confidence for r in bid) >= best - 5 * works.RAISE


@pytest.mark.parametrize("cut", [True, False])
def test_neighbours_cross_partitions(spark, cut):
    # neighbours of one order, whichever partitions it is cut into
    rows = [(i, "c", f"study of x{i % 7} word{i:03d}abcdefgh", "", "", None, None, None, None, 1) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node long, source string, title string, kind string, author string, year int, volume long, page long, journal long, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", cut)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    got = {(r.a, r.b) for r in works.neighbours(nodes, [F.substring_index("title", " ", -1)], window=3).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {(i, j) for i in range(60) for j in range(i + 1, min(i + 4, 60))}


PAGES = [(f"The old {a}\n{line}\n{b} was lost in it.") for i in range(8) for a, b in (("market", "border"), ("public", "valley")) for line in (f"- {i + 3} -", f"{40 + i}  Annals of River Engineering", f"Page {i} of 9")] + [f"The old {a}\nand {b} were lost\nin the valley." for a in ("market", "border", "timber") for b in ("session", "public", "harbour")]


def test_noise(spark):
    words = ["museum", "market", "valley", "timber", "harbour", "session", "modern", "border", "public", "region"]
    rows = [("sentence", i, f"The {w} of the old {v} was lost in the long-term plan of the well-known site.") for i, (w, v) in enumerate((w, v) for w in words for v in words)]
    rows += [("sentence", 300 + i, t) for i, t in enumerate(PAGES)]
    cases = {900: "The mu5eum was lost.", 901: "The modcrn plan was lost.", 902: "The har-\nbour was lost in it.", 903: "The ﬁrst plan was lost.", 904: "The old\n- 38 -\nmarket was lost.", 905: "The tirnber was lost.", 906: "The marekt was lost.", 907: "The plan K45-8 held H2O.", 908: "The old\nmarket was lost.", 909: "The long-\nterm plan was lost.", 910: "The old\n88  Annals of River Engineering\nmarket was lost."}
    rows += [("sentence", i, t) for i, t in cases.items()] + [("sentence", 990, None), ("citation", 991, ""), ("sentence", 920, "The well-\nknown har-\nbour was\nlost.\n\nThe old mu5eum\nwas lost.")]
    judged = noise.Judgement(spark.createDataFrame(rows, "record_kind string, record_id long, text string").withColumn("word", F.lit("x")))
    assert {r.record_id for r in judged.found().where("record_id >= 900").collect()} == {900, 901, 902, 903, 904, 905, 910, 920}
    fixed = {r.record_id: r.repaired_text for r in judged.repaired().collect()}
    assert fixed[900] == "The museum was lost." and fixed[902] == "The harbour was lost in it." and fixed[904] == "The old market was lost." and fixed[905] == "The timber was lost."
    assert fixed[909] == "The long-term plan was lost." and fixed[920] == "The well-known harbour was lost.\n\nThe old museum was lost."


def test_furniture_lines_by_repetition():
    # no outline is written down anywhere: repetition tells them, and running text with a line to itself stays
    lines = noise.Lines(PAGES)
    assert [bool(lines.furniture(t)) for t in ("It was\nPage 3 of 8\nlost here.", "It was\nlost in\nthe valley.", "A sentence.\nAnother one there.\nThe last one.")] == [True, False, False]
    assert noise.shape("  - 38 - ") == "- 9 -" and noise.shape("VON TAL ET AL.") == "A A." and noise.shape("231  Annals of Cave Biology") == "9  Aa a Aa"


def test_noise_candidates_at_every_length(spark):
    rng = random.Random(2)
    right = ["of", "the", "boat", "river", "market", "letters", "historic", "archivist", "settlement", "observatory", "architecture", "administration"]
    wrong = {}
    for word in right:
        for i in range(len(word)):
            wrong[word[:i] + rng.choice("kqz") + word[i + 1 :]] = word
    rows = [([w] * 50,) for w in right] + [([w],) for w in wrong]
    got = {(r.word, r.right) for r in noise.candidates(noise.vocabulary(spark.createDataFrame(rows, "words array<string>"))).collect()}
    assert {(w, r) for w, r in wrong.items() if len(w) > 2} <= got


def test_noise_unlisted_sign(spark):
    words = ["museum", "market", "valley", "timber", "harbour", "session", "modern", "border", "public", "region"]
    rows = [("sentence", i, f"The {w} of the old {v} was lost.") for i, (w, v) in enumerate((w, v) for w in words for v in words)]
    rows += [("sentence", 900, "The m4rket was lost."), ("sentence", 901, "The old modu1es and sess7on were lost."), ("sentence", 902, "The market2 was lost."), ("sentence", 903, "The markat was lost."), ("sentence", 904, "The 6market was lost.")]
    judged = noise.Judgement(spark.createDataFrame(rows, "record_kind string, record_id long, text string"))
    assert {r.record_id for r in judged.found().collect()} == {900, 901}
    fixed = {r.record_id: r.repaired_text for r in judged.repaired().collect()}
    assert fixed[900] == "The market was lost." and "session" in fixed[901]


def test_noise_codes_that_are_words(spark):
    words = ["laboratory", "market", "valley", "timber", "harbour", "session", "modern", "border", "public", "region"]
    rows = [("sentence", i, f"The {w} was lost for the {v}.") for i, (w, v) in enumerate((w, v) for w in words for v in words)]
    rows += [("sentence", 900, "THE LA8ORATORY was lost."), ("sentence", 901, "It was lost f0r the market."), ("sentence", 902, "†he market was lost."), ("sentence", 903, "The 8ORDER was lost."), ("sentence", 904, "The tbe was K45 in H2O of 1850, 5th of A1, 10S.")]
    judged = noise.Judgement(spark.createDataFrame(rows, "record_kind string, record_id long, text string"))
    assert {900, 901, 902, 903} <= {r.record_id for r in judged.found().collect()}
    got = {(r.record_id, r.word, r.right) for r in judged.misread().collect()}
    assert {(900, "la8oratory", "laboratory"), (901, "f0r", "for"), (902, "†he", "the"), (903, "8order", "border")} <= got and not {w for i, w, _ in got if i == 904} - {"tbe"}
    assert ("tbe", "the") in {(r.word, r.right) for r in noise.candidates(judged.vocabulary).collect()}


def test_noise_models_of_all_rows(spark):
    # furniture of texts of more than 20,000 characters
    rows = [("sentence", i, "The old valley was lost in it. " * 700 + f"The old market\n- {i + 3} -\nborder was lost.") for i in range(8)] + [("sentence", 99, "The old\nmarket was lost.")]
    judged = noise.Judgement(spark.createDataFrame(rows, "record_kind string, record_id long, text string"))
    assert {r.record_id for r in judged.found().collect()} == set(range(8))
    assert all(r.repaired_text.endswith("The old market border was lost.") for r in judged.repaired().where("record_id < 9").collect())


def test_noise_examples_of_all_words(spark):
    import itertools

    import numpy as np

    words = ["".join(w) for w in itertools.product("abcdefgh", repeat=5)][:7_000]
    tagged = spark.createDataFrame([("w", w, 4) for w in words] + [("c", f"{w}-{w}", 1) for w in words] + [("b", "har\t\u00ac\tbour", 1), ("b", "har\t-\tbour", 1)], "tag string, item string, n long").repartition(7)
    cut = noise.pair_examples(tagged).collect()
    assert len(cut) == 14_000 and {r.left + r.rest for r in cut if not r.own} == set(words) and {r.sign for r in cut if not r.own} == {"-", "\u00ac"}
    x, y, n = noise.tallied(tagged.where("tag = 'w'").select("item"), noise._examples)
    assert n.sum() == sum(k for w in words for _, k in noise._examples(w)) and len(n) < 1_000 and set(y) == {0, 1}
    # equal examples together or one by one: the same trees
    one_by_one = boost.Boosted().fit(np.repeat(x, n.astype(int), 0), np.repeat(y, n.astype(int)))
    assert np.allclose(boost.Boosted().fit(x, y, n).score(x), one_by_one.score(x))


def test_noise_explained_replacements_first(spark):
    words = ["describe", "museum", "market", "valley", "timber", "harbour", "session", "modern", "border", "public"]
    rows = [("sentence", i, f"The {w} of the old {v} was lost.") for i, (w, v) in enumerate((w, v) for w in words for v in words)]
    rows += [("sentence", 200 + i, "The descrlbed was lost.") for i in range(15)] + [("sentence", 900, "They de5cribe it.")]
    judged = noise.Judgement(spark.createDataFrame(rows, "record_kind string, record_id long, text string"))
    assert {(r.word, r.right) for r in judged.misread().where("record_id = 900").collect()} == {("de5cribe", "describe")}


def test_boost_learns_and():
    import numpy as np

    x = np.random.default_rng(0).random((500, 3))
    y = (x[:, 0] > 0.5) & (x[:, 1] > 0.3)
    assert ((boost.Boosted().fit(x, y).score(x) > 0.5) == y).mean() > 0.97


@pytest.mark.parametrize("name", ["p1_found", "p1_repaired", "p2_found", "p2_entities", "p3_found", "p4_found", "p4_works", "p5_found", "p7_found", "p8_decoded", "p9_cleaned", "p10_pieces"])
def test_queries_run(spark, sf, name):
    from quillmark.llm import queries

    df = queries.queries()[name](spark, sf)
    columns = {
        "p1_found": ["record_kind", "record_id"], "p2_found": ["rec_a", "rec_b"], "p3_found": ["doc_id", "reading_level"], "p4_found": ["mapping_id", "ref_row_id"],
        "p5_found": ["sentence_id", "start_pos", "end_pos"], "p7_found": ["paper_id", "section", "ngram"],
    }
    rows = df.collect()
    assert rows and (name not in columns or (df.columns == columns[name] and len(set(rows)) == len(rows)))
    if name == "p8_decoded":
        assert {r.doc_id: r.text for r in rows} == {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
