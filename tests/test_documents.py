from pyspark.sql import functions as F

from quillspark.functions import boxes, constants as C, display, text as T
from quillspark.operators import analytics, documents as D


def outline(spark, text):
    rows = D.outline(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("section").collect()
    return rows


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*(F.col(n) for n in names)).alias("x")).first()["x"]


def test_numbered_headings(spark):
    rows = outline(spark, "1 总则\n内容\n1.1 范围\n范围内容")
    assert [r["title"] for r in rows][:2] == ["未分章节", "1 总则"]
    assert rows[-1]["section_path"] == ["1 总则", "1.1 范围"] and rows[-1]["level"] == 2


def test_chapter_headings(spark):
    assert outline(spark, "第一章 总则\n这里是内容")[-1]["section_path"] == ["第一章 总则"]
    assert outline(spark, "第二节 其他\n正文")[-1]["level"] == 2


def test_hash_headings_and_jumps(spark):
    assert outline(spark, "## 二级标题\n正文")[-1]["level"] == 2
    assert outline(spark, "# A\n正文\n## B\n正文")[-1]["section_path"] == ["A", "B"]
    assert outline(spark, "# A\n正文\n## B\n正文\n# C\n正文")[-1]["section_path"] == ["C"]
    assert any(r["jump"] for r in outline(spark, "# A\n### C\n正文"))


def test_text_without_headings_and_empty_text(spark):
    (r,) = outline(spark, "只有正文")
    assert (r["title"], r["content"], r["page_start"]) == ("未分章节", "只有正文", 1)
    for text in ("", "  \n ", None):
        (r,) = outline(spark, text)
        assert r["content"] == "" and r["page_start"] is None and r["page_end"] is None


def test_titles_without_content_go(spark):
    rows = outline(spark, "# A\n# B\ntext")
    assert [r["title"] for r in rows] == ["未分章节", "B"] and rows[-1]["section_path"] == ["B"]


def test_pages(spark):
    rows = outline(spark, "x\n<--- Page Split --->\n# A\ny\n<--- Page Split --->\nz\n# B\nw")
    assert [(r["title"], r["page_start"], r["page_end"]) for r in rows] == [("未分章节", 1, 2), ("A", 2, 3), ("B", 3, 3)]
    assert rows[1]["content"] == "y\nz"


def chunks(spark, text, limit, overlap):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    return D.chunks(D.outline(docs), limit, overlap).orderBy("chunk_index").collect()


def test_chunks_stay_in_sections(spark):
    rows = chunks(spark, "# A\n甲\n# B\n乙", 10, 0)
    assert [tuple(r["section_path"]) for r in rows] == [("A",), ("B",)]
    assert [r["chunk_index"] for r in rows] == [0, 1]


def test_long_pieces_are_cut(spark):
    rows = chunks(spark, "# A\n" + "字" * 40, 10, 0)
    assert [r["content"] for r in rows] == ["字" * 10] * 4


def test_paragraphs_are_packed(spark):
    assert chunks(spark, "# A\n第一段\n\n第二段", 20, 0)[0]["content"] == "第一段\n\n第二段"
    assert len(chunks(spark, "# A\n第一段文字\n\n第二段文字\n\n第三段文字", 10, 4)) >= 2
    assert chunks(spark, "# A\n", 512, 64) == []


def test_overlap_is_carried_and_may_repeat(spark):
    rows = [r["content"] for r in chunks(spark, "aa bb cc\n\ndd ee ff\n\ngg hh ii", 6, 3)]
    assert rows == ["aa bb cc\n\ndd ee ff", "dd ee ff\n\ngg hh ii"]
    rows = [r["content"] for r in chunks(spark, "aa bb\n\n" + "字" * 9, 6, 2)]
    assert rows == ["aa bb", "aa bb", "字" * 6, "字" * 3]


def test_tokens_and_types(spark):
    assert one(spark, T.count_tokens, "abc 中美 RAG") >= 4
    assert one(spark, T.count_tokens, "a_b é!é! zz") == 2 + 6 // 4
    kinds = {"| a |": "table", " ![](x.png)": "image", "a $$x$$": "formula", "x\n - y": "list", "<table>": "paragraph", "a-b": "paragraph"}
    assert {t: one(spark, T.content_type, t) for t in kinds} == kinds


def test_clean_text(spark):
    assert one(spark, T.clean, "a&lt;b&gt;x&lt;/b&gt;&amp;lt; <td>1</td>\n  2") == "a x &lt; 1 2"
    assert one(spark, T.clean, "&eacute;&#x41; &amp;lt; AT&T &notit; &ampx &#0;") == "éA &lt; AT&T ¬it; &x \ufffd"


def test_terms(spark):
    rows = {r["term"]: r["weight"] for r in one(spark, T.terms, "Ab_1 施工 é方")}
    assert rows == {"ab_1": 1.0, "施": 0.5, "工": 0.5, "施工": 1.0, "方": 0.5}


def test_sparse_dimensions_are_stable(spark):
    import hashlib

    expect = int.from_bytes(hashlib.blake2b("施工".encode(), digest_size=8).digest(), "big") % 500_000 + 1
    assert one(spark, T.sparse_dimension, "施工") == expect


def test_dense_literal(spark):
    assert one(spark, T.dense_literal, [0.1]) == "[0.1]"
    assert one(spark, T.dense_literal, [1.0, float("nan"), 2.5]) == "[1,2.5]"


def test_citation_marks_go(spark):
    assert one(spark, T.drop_citations, "第一段[cite:1]。第二段[cite:9]。第三段^[1]。") == "第一段。第二段。第三段。"


def test_no_evidence(spark):
    assert one(spark, T.no_evidence, "抱歉， 无法在知识库中\n找到依据。") and not one(spark, T.no_evidence, "有依据")


def test_lines_end_as_in_unicode(spark):
    assert one(spark, T.lines, "a\r\nb\rc d\n") == ["a", "b", "c", "d"]
    assert one(spark, T.lines, "a\n\n") == ["a", ""]


def test_boxes(spark):
    args = [100.0, 50.0, 300.0, 900.0, 200.0, 1000.0]
    b = one(spark, boxes.from_pixels, *args)
    assert tuple(b) == (0.5, 0.05, 1.0, 0.85)
    assert tuple(one(spark, boxes.from_bottom_left, *args)) == (0.5, 0.1, 1.0, 0.85)
    assert tuple(one(spark, boxes.from_pixels, 1.0, 1.0, 2.0, 2.0, 0.0, 0.0)) == (0, 0, 0, 0)
    assert one(spark, boxes.from_grid, 10.0, 10.0, 10.0, 20.0, 999, 999) is None
    g = one(spark, boxes.from_grid, 999.0, 0.0, -5.0, 499.5, 100, 200)
    assert tuple(g) == (0.0, 0.0, 1.0, 0.5)


def test_box_fragments(spark):
    assert one(spark, boxes.fragment, {"x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}) == "#bbox=1,2,3,4"
    assert one(spark, boxes.fragment, {"left": 1.5, "top": 2.0, "w": 3.0, "h": 4.0}) == "#bbox=1.5,2,3,4"
    assert one(spark, boxes.fragment, {"x": 1.0}) == ""


def test_clauses(spark):
    assert one(spark, display.last_clause, "见 4.9 与 4.10.2 款") == "4.10.2"
    assert one(spark, display.citation_clause, ["1.2 a", "b"], "3.4") == "1.2"
    assert one(spark, display.citation_clause, ["a", "b"], "3.4") == "3.4"
    assert one(spark, display.source_label, ["a", "b", " "]) == "b"
    assert one(spark, display.plain_math, r"5^{\circ}C \sim 35^{\circ}C \leq x_{1}") == "5°C 至 35°C ≤ x_1"


def test_byte_ranges(spark):
    cases = {"bytes=0-3": (0, 3, 206), "bytes=8-": (8, 9, 206), "bytes=-4": (6, 9, 206), "bytes=-99": (0, 9, 206), "bytes=3-99": (3, 9, 206)}
    cases |= {"bytes=10-": (None, None, 416), "bytes=5-2": (None, None, 416), "bytes=-0": (None, None, 416), "x": (None, None, 416), "bytes=-": (None, None, 416)}
    for header, expect in cases.items():
        assert tuple(one(spark, lambda c: display.byte_range(c, F.lit(10).cast("long")), header)) == expect, header


def text_of(spark, function, text):
    return function(spark.createDataFrame([(1, text)], "id long, text string")).first()["text"]


def test_repeated_lines_and_units(spark):
    assert text_of(spark, D.collapse_lines, "a b\nab\n a b\n\n\n\nc\n") == "a b\nab\n\nc"
    assert text_of(spark, D.collapse_units, "施工方案内容，施工方案内容。短，短，abc def;abcdef!") == "施工方案内容，短，短，abc def;abcdef!"


def test_heading_loops(spark):
    loop = "\n".join(f"{i}.1 重复标题" for i in range(1, 9))
    assert text_of(spark, D.cut_heading_loops, "开头\n" + loop + "\n尾") == "开头"
    free = "\n".join(f"{i}.1 标题{i}" for i in range(1, 9))
    assert text_of(spark, D.cut_heading_loops, free) == free
    docs = spark.createDataFrame([(1, "x" * 30), (2, "short"), (3, "长" * 30 + "\n" + loop)], "id long, text string")
    assert {r["id"]: r["usable"] for r in D.usable(docs).collect()} == {1: True, 2: False, 3: False}


def test_grounding(spark):
    assert one(spark, D.strip_grounding, "a\n<|ref|>x<|/ref|>\nb") == "a\nb"
    tags = one(spark, D.grounding_tags, "<|ref|>image<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|> <|ref|>t<|/ref|><|det|>bad<|/det|>")
    assert [(t["label"], t["box"], t["is_image"]) for t in tags] == [("image", [[1, 2, 3, 4]], True), ("t", None, False)]
    assert one(spark, D.insert_images, "a\n图 1\nb", ["x.jpg"]) == "a\n![](images/x.jpg)\n图 1\nb"
    assert one(spark, D.insert_images, "a", ["x.jpg", "y.jpg"]) == "![](images/x.jpg)\n![](images/y.jpg)\na"


def test_simple_outline(spark):
    docs = spark.createDataFrame([(1, "## T\n第一章\n1.2 x\n12 y\nplain")], "id long, text string")
    assert [(r["level"], r["title"]) for r in D.simple_outline(docs).orderBy("n").collect()] == [(2, "T"), (1, "第一章"), (1, "1.2 x")]


def test_char_vectors(spark):
    rows = {r["id"]: r["vector"] for r in D.char_vectors(spark.createDataFrame([(1, "aAb"), (2, ""), (3, None)], "id long, text string")).collect()}
    assert len(rows[1]) == 256 and abs(rows[1][97] - 2 / 5**0.5) < 1e-12 and abs(rows[1][98] - 1 / 5**0.5) < 1e-12
    assert set(rows[2]) == set(rows[3]) == {0.0}


def test_formulas_and_answers(spark):
    cases = {
        r"t $$\text{flow}^{2}$$ end": "t flow^2 end", r"$a_{1}$ and $b$": "a_1 and b", r"\(x \leq 3\)": "x ≤ 3", r"\[20^{\circ} C\]": "20°C",
        r"5 $\sim$ 7": "5 至 7", "cost $5\nand $6": "cost $5\nand $6", r"$\alpha\cdot\beta$": "alpha·beta", "plain {x}": "plain {x}", r"$10\%$": "10%",
        r"$$a$$$$b$$": "ab", r"\( {a} \) \[ {b} \]": "a b", "": "", "$ $": "", r"$x\times y$ $z\pm 1$": "x× y z± 1",
    }
    assert {t: one(spark, display.normal_math, t) for t in cases} == cases
    refs = {"a\n## References:\nb": "a", "a\r\n**参考资料**\r\nb": "a", "引用依据：": "", "References are good\nb": "References are good\nb", "a\nb": "a\nb", "x\n  参考文档 \ny\nReferences": "x"}
    assert {t: one(spark, display.without_references, t) for t in refs} == refs
    assert one(spark, display.normal_answer, " Use $M^{2}$ bolts [cite:1]^[2].  \n\n\n\nDone[^3]\nReferences\n[1] x") == "Use M^2 bolts .\n\nDone"


def test_pages_are_assembled(spark):
    tag = lambda label, box: f"<|ref|>{label}<|/ref|><|det|>{box}<|/det|>"
    end, image, bad = C.END_MARK, tag("image", "[[1, 2, 3, 4]]"), tag("image", "oops")
    pages = [
        ("d", 1, f"{tag('title', '[[1,1,2,2]]')}Second page \\\\coloneqq two{end}".replace("\\\\", "\\")),
        ("d", 0, f"First\n{image}\nmiddle {image}{bad}{tag('image', '[[5,6,7,8]]')}tail{end}"),
        ("d", 2, "too short"), ("d", 3, "this page broke off but has more than twenty characters"), ("e", 0, None), ("e", 1, "x"),
    ]
    rows = {r["id"]: (r["text"], r["page_count"]) for r in D.assemble_pages(spark.createDataFrame(pages, "id string, page_no int, content string")).collect()}
    split = f"\n\n{C.PAGE_SPLIT}\n"
    text, count = rows["d"]
    parts = text.split(split)
    assert count == 4 and len(parts) == 4 and parts[3] == "" and parts[1] == "Second page := two" and parts[2].startswith("this page broke off")
    assert "<|" not in text and "0_0.jpg" in parts[0] and "0_2.jpg" in parts[0] and parts[0].endswith("tail") and rows["e"] == ("", 2)


def test_keyword_sketches_stay_within_their_bound(spark):
    import random

    rng = random.Random(1)
    docs = [(f"k{i % 3}", i % 4, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(200))) for i in range(60)]
    rows = spark.createDataFrame(docs, "kb string, day int, text string")
    exact = {r["term"]: r["n"] for r in analytics.hot_terms(rows, k=100_000).collect()}
    sketches = analytics.term_sketches(rows, ["kb", "day"])
    assert sketches.count() == 12
    found = analytics.sketched_terms(sketches, 20).collect()
    bound = sum(exact.values()) / (0.75 * 10_000)
    assert len(found) == 20 and all(abs(r["n"] - exact[r["term"]]) <= bound for r in found)
    assert {r["term"] for r in found[:5]} == set(sorted(exact, key=lambda t: (-exact[t], t))[:5])


def test_repeats_are_dropped_where_the_texts_lie(spark):
    """No shuffle and no window over lines: a text is one row throughout."""
    docs = spark.createDataFrame([(1, "a b\nab\n a b\n\n\n\nc\n"), (2, None), (3, "")], "id long, text string")
    for make in (D.kept_lines, D.collapse_lines, D.collapse_units, D.cut_heading_loops, D.sanitize):
        assert "Exchange" not in make(docs)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, D.kept_lines(docs).collect())) == [(1, 0, "a b"), (1, 1, "ab"), (1, 3, ""), (1, 6, "c")]
    assert sorted(map(tuple, D.sanitize(docs).collect())) == [(1, "a b\nab\n\nc"), (2, ""), (3, "")]


def test_packing_counts_each_piece_once_and_keeps_tails():
    """A piece is counted once, a full text's tail once more: work grows with the pieces."""
    assert D._tail([("a", 1), ("b", 2), ("c", 3)], 4) == [("b", 2), ("c", 3)] and D._tail([("a", 1)], 9) == [("a", 1)] and D._tail([("a", 1)], 0) == []
    assert D._pack([("a b", 2), ("c d e", 3), ("f", 1), ("x" * 9, 9), ("g", 1)], 5, 2) == ["a b\n\nc d e", "c d e\n\nf", "c d e\n\nf", "xxxxx", "xxxx", "g"]
    assert [D._tokens(x) for x in ("", "ab, 施工!!", "....", "ñandú 1")] == [0, 4, 1, 2]


def test_first_lines_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a b\nab\n a b\n\n\n\nc\n"), (2, None), (3, ""), (4, "x\ny\nx"), (4, "y\nz\ny"), (None, "x"), (None, "x"), (None, "x")], "id long, text string")
    rows = [(1, 0, "a b"), (1, 1, "ab"), (1, 3, ""), (1, 4, ""), (1, 6, "c"), (3, 0, ""), (4, 0, "x"), (4, 0, "y"), (4, 1, "y"), (4, 1, "z"), (4, 2, "x"), (None, 0, "x"), (None, 0, "x")]
    assert sorted(map(tuple, D.first_lines(docs).collect()), key=repr) == sorted(rows, key=repr)
    once = [r for r in D.first_lines(docs, 1).collect() if r["id"] == 4]
    assert sorted(map(tuple, once)) == [(4, 0, "x"), (4, 0, "y"), (4, 1, "z")]
