"""Lines are read in one pass with one order; heads are counted, not sorted apart."""

from quotelake.operators.sections import DISPLAY_WORDS, NO_MODEL_WORDS, NO_NAME, SUBTOTALS, SUM_WORDS, TABLE_HEADS, split_sections


def test_lines_are_read_once(spark):
    docs = spark.createDataFrame([(1, "t", [1, 2])], "quote_id long, text string, targets array<bigint>")
    plan = split_sections(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(filter(transform(split(") == 1  # before, subtotals and items read them each
    assert "quote_id, is_head" not in plan


def test_the_fourth_head_back_starts_a_section(spark):
    item = "브라켓\n2\n10,000\n20,000\n"
    wall = "비디오월\n1\n50,000\n50,000\n"
    five = f"LED\n1\n70,000\n70,000\n번호\n{item}품목\n수량\n견적단가\n번호\n{item.replace('브라켓', '케이블')}소계\n40,000\n{wall}소 계\n50,000\n"
    three = f"{item}번호\n품목\n수량\n{item.replace('브라켓', '케이블')}소계\n40,000\n{wall}소\t계\n50,000\n"
    rows = [(1, five, [20_000, 50_000]), (2, five.replace("소계\n40,000", "소계\n20,000"), [20_000, 50_000]), (3, three, [40_000, 50_000])]
    got = {}
    for r in split_sections(spark.createDataFrame(rows, "quote_id long, text string, targets array<bigint>"), 0).collect():
        got.setdefault(r.quote_id, set()).add((r.option_no, r.item_name))
    assert got == {2: {(1, "케이블"), (2, "비디오월")}, 3: {(1, "브라켓"), (1, "케이블"), (2, "비디오월")}}


def test_words_without_capitals():
    assert not any(c.isascii() and c.isalpha() for w in [*TABLE_HEADS, *NO_NAME, *SUBTOTALS, *SUM_WORDS] for c in w)
    assert not any("k" in w or w.endswith("i") for w in [*DISPLAY_WORDS, *NO_MODEL_WORDS])
