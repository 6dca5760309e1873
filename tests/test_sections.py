"""Option folds and rebuilt sections against plain versions."""

import random
import time

from pyspark.sql import functions as F

from quotelake.operators.sections import split_sections
from quotelake.operators.split import fold_options, option_of_line, section_triples


def _fold(amounts, targets, tolerance=10_000):
    numbers, option, total, closed = [], 1, 0, 0
    for a in amounts:
        numbers.append(option)
        total += a or 0
        if option <= len(targets) and targets[option - 1] is not None and abs(total - targets[option - 1]) <= tolerance:
            option, total, closed = option + 1, 0, closed + 1
    return numbers, closed


def test_fold_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(0, [], [1]), (1, [5, None, 7], []), (2, [100_000] * 4, [200_000, 200_000])]
    for i in range(3, 200):
        amounts = [rng.choice([None, 0, 30_000, 50_000, 100_000]) for _ in range(rng.randint(0, 12))]
        rows.append((i, amounts, [rng.choice([0, 50_000, 100_000, 200_000, None]) for _ in range(rng.randint(0, 4))]))
    df = spark.createDataFrame(rows, "i int, amounts array<bigint>, targets array<bigint>").withColumn("f", fold_options(F.col("amounts"), F.col("targets")))
    got = df.select("i", option_of_line(F.col("f.cuts"), F.col("f.lines")).alias("n"), F.size("f.cuts").alias("closed")).collect()
    want = {i: _fold(a, t) for i, a, t in rows}
    assert {r["i"]: (r["n"], r["closed"]) for r in got} == want


SECTION = "번호\n품목\n수량\n견적단가\n{a}소계\n{sa}\n합계\n{b}소 계\n비고\n{sb}\n"


def _item(name, n, price, before=""):
    return f"{before}{name}\n{n}\n{price:,}\n{n * price:,}\n"


def test_sections(spark):
    led = _item("모델 AB12", 2, 1_000_000, "LED Display 세트\n")
    post = _item("브라켓", 3, 20_000)
    wall = _item("비디오월", 1, 5_000_000)
    good = SECTION.format(a=led + post + post, sa="2,060,000", b=wall, sb="5,000,000")
    rows = [
        (1, good, [2_060_000, 5_000_000]), (2, good, [2_060_000, 5_000_001]), (3, good, [5_000_000, 2_060_000]), (4, good, [2_060_000]), (5, good, None),
        (6, None, [1, 2]), (7, "", [1, 2]), (8, good.replace("2,060,000", "2,068,000"), [2_068_000, 5_000_000]),  # within the tolerance
        (9, good.replace("2,060,000", "2,090,000"), [2_090_000, 5_000_000]), (10, good, [2_060_000, None]), (11, good.replace("\n", "\r\n \n"), [2_060_000, 5_000_000])]
    got = {}
    for r in split_sections(spark.createDataFrame(rows, "quote_id long, text string, targets array<bigint>")).collect():
        got.setdefault(r["quote_id"], set()).add((r["option_no"], r["item_name"], r["quantity"], r["unit_price"], r["supply_amount"], r["option_sum"]))
    first = {(1, "LED Display", 2.0, 1_000_000, 2_000_000, 2_060_000), (1, "브라켓", 3.0, 20_000, 60_000, 2_060_000), (2, "비디오월", 1.0, 5_000_000, 5_000_000, 5_000_000)}
    assert got == {1: first, 3: {(3 - o, *rest) for o, *rest in first}, 8: first, 11: first}


def test_long_documents_take_linear_time(spark):
    part = "".join(_item(f"품명 {i}", 2, 10_000 + i) for i in range(20_000))
    text = f"{part}소계\n{sum(2 * (10_000 + i) for i in range(20_000)):,}\n{_item('비디오월', 1, 5_000_000)}소계\n5,000,000\n"
    df = spark.createDataFrame([(1, text, [sum(2 * (10_000 + i) for i in range(20_000)), 5_000_000])], "quote_id long, text string, targets array<bigint>")
    start = time.time()
    assert split_sections(df).count() == 20_001
    assert section_triples(df).count() == 20_001
    assert time.time() - start < 60
