import random

from lodetrace.llm.leakage import LeakScanner, find_leaks, word_spans, words

P0 = "Engineers at Vornask traced 812 broken installs back to kelp-render 2.0.1, where Ostrivane had swapped the main loader for a nested copy while the second mirror kept serving the earlier archive to every worker"
P1 = P0.replace("Vornask", "Tallimer").replace("kelp-render 2.0.1", "moss-core 4.4.0").replace("Ostrivane", "Quendle").replace("812", "77")
OTHERS = [P0.replace("Vornask", f"Vor{i}a").replace("kelp-render 2.0.1", f"lib{i} {i}.9.9").replace("Ostrivane", f"Ost{i}b").replace("812", f"90{i}") for i in range(3)]
ITEMS = [(0, P0, "block kelp"), (1, P1, "block moss"), *((10 + i, p, "keep") for i, p in enumerate(OTHERS)), (2, "too short", "x"), (3, None, None), (4, "", "")]


def found(text):
    return [h.item for h in LeakScanner(ITEMS).scan(text) if h.kind == "passage"]


def test_whole_cased_marked_up_and_wrapped():
    assert found("Intro.\n\n" + P0 + "\n") == [0]
    assert found(P0.upper().replace(",", "").replace("2.0.1", "201")) == [0]
    assert found("> " + P0.replace(" ", "\n> ", 9).replace("traced", "**traced**").replace("copy", "`copy`").replace("main", "<b>main</b>")) == [0]
    assert found(P1 + "\n" + P0) == [0, 1]


def test_stretches():
    w = P0.split()
    need = -(-len(words(P0)) // 3)
    assert need <= 12 and found("x " + " ".join(w[2:14]) + " y") == [0]
    assert found("x " + " ".join(w[2:13]) + " y") == []


def test_replaced_words_and_other_names():
    assert found(P0.replace("broken", "failed").replace("main ", "").replace("nested", "very nested")) == [0]
    assert found(P0.replace("Vornask", "Gellow").replace("kelp-render 2.0.1", "fern 1.1.1").replace("Ostrivane", "Pim").replace("812", "5")) == []
    assert found("Engineers traced broken installs back to the main loader") == []
    assert found("") == [] and LeakScanner([]).scan(P0) == []


def test_offsets_lie_in_the_original(spark):
    text = "Zuerst etwas.\r\n\n" + P0.replace(" ", "  ", 3) + " -- Ende"
    df = spark.createDataFrame([(5, text, 1), (6, None, 1), (7, "", 1), (5, text, 1), (8, "lorem " * 100_000 + P1, 1)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, passage string, answer string")
    rows = find_leaks(df, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(5, 0), (5, 0), (8, 1)]
    r = next(x for x in rows if x.doc_id == 5)
    assert text[r.start : r.end].startswith("Engineers") and text[r.start : r.end].endswith("worker")
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


def test_words_and_spans_agree():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab1 .,-*_<>/\n é—") for _ in range(60))
        assert len(words(t)) == len(word_spans(t))
        assert [words(t[a:b]) for a, b in word_spans(t) if "<" not in t] == ([[w] for w in words(t)] if "<" not in t else [])


def test_blocks_and_passages_of_one_item(spark):
    texts = [P0, P1, P0.replace("mirror kept", "mirror worker"), *(p.replace("broken", "loader") for p in OTHERS), *OTHERS, P0.replace("broken", "failed")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([*ITEMS, (0, OTHERS[0].replace("90", "33"), "block kelp"), (0, P1, "other")], "item_id bigint, passage string, answer string")
    whole = sorted(map(tuple, find_leaks(docs, items).collect()))
    assert sorted(map(tuple, find_leaks(docs, items, most_chars=300).collect())) == whole
    pairs = {(d, i) for d, i, kind, *_ in whole}
    assert {(0, 0), (1, 0), (1, 1)} <= pairs and len(pairs) == len(whole)


def test_answers_alone_and_long_tags():
    hits = LeakScanner(ITEMS).scan("As they said: Block, KELP! And more.")
    assert [(h.kind, h.item, h.first, h.last) for h in hits] == [("answer", 0, 3, 4)]
    assert [h.kind for h in LeakScanner(ITEMS).scan(P0 + " block kelp")] == ["passage"] and LeakScanner(ITEMS).scan("keep it") == []
    tag = '<span class="' + "wide " * 40 + '" data-x=1 hidden>'
    assert found(P0.replace("nested", tag + "nested</span>")) == [0]
    assert words("if a <b and c> d or List<int> <b") == words("if a   d or List  <b") and words("<" * 50_000 + "a " * 50_000)[:2] == ["a", "a"]


def test_stretches_equal_a_search_without_shortcuts():
    """Every stretch the scanner may report, by trying all of them."""
    r = random.Random(8)
    scanner = LeakScanner(ITEMS)
    for n in range(60):
        ws = words(r.choice([P0, P1, *OTHERS]))
        for _ in range(r.randint(0, 8)):
            i = r.randrange(len(ws))
            ws[i : i + r.randint(0, 1)] = r.choice([[], ["filler"], [ws[r.randrange(len(ws))]]])
        cut = ws[r.randrange(6) : len(ws) - r.randrange(14)]
        for k, (item, passage) in enumerate(scanner.items):
            need = max(12, -(-len(passage) // 3))
            if len(passage) < need:
                continue
            where = {}
            for j, w in enumerate(cut):
                where.setdefault(w, []).append(j)
            plain = scanner._chain(passage, [w in scanner.own for w in passage], 0, len(passage), cut, where, need)
            assert scanner._stretch(passage, cut, 0, len(cut), need) == plain, n
