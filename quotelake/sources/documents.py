"""Quote documents, tables and request forms written out from the order tables.

The star schema holds no Korean business text, so each order is rendered to the
texts and tables a supplier would send. The extraction jobs then have to find the
original columns again. Rendering is a narrow projection: one order, one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.sources.marts import table


def won(amount: Column) -> Column:
    return F.format_number(amount, 0)


def _pick(number: Column, options: list) -> Column:
    """``options[number]`` as a CASE expression."""
    out = F.when(number == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(number == i, option)
    return out


def _text(column: Column) -> Column:
    return column.cast("string")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows over every core, whatever the layout of the source.

    Rendering turns a few narrow columns into whole documents, so the narrow rows are moved,
    never the texts. The number of splits says nothing about rows: of the splits of a file only
    those that hold the middle of a row group get any, and one row group may hold a million rows.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else 4 * splits, key)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures each document states."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return spread(orders, "o_orderkey").select(
        k.alias("quote_id"),
        F.col("o_custkey").alias("project_id"),
        F.to_date("o_orderdate").alias("stated_date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("supply"),
    ).withColumn("tax", F.expr("supply div 10")).withColumn("total", F.col("supply") + F.col("tax"))


def date_text() -> Column:
    d = F.col("stated_date")
    return _pick(
        F.col("quote_id") % 3,
        [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy.M.d"), F.date_format(d, "yyyy년 M월 d일")],
    )


def amount_text() -> Column:
    s, t, z = won(F.col("supply")), won(F.col("tax")), won(F.col("total"))
    return _pick(
        F.col("quote_id") % 3,
        [
            F.concat_ws("\n", F.concat(F.lit("공급금액 "), s), F.concat(F.lit("세액 "), t), F.concat(F.lit("VAT 포함 총금액 "), z)),
            F.concat_ws("\n", F.lit("공급금액"), s, F.lit("세 액"), t, F.lit("총금액"), z),
            F.concat_ws("\n", F.concat(F.lit("VAT 별도 합계 "), s, F.lit("  "), t), F.concat(F.lit("VAT 포함 "), z)),
        ],
    )


WARRANTY_LINES = [
    "유지보수 : 설치완료일로부터 2년 무상 (출장실비 별도)",
    "시공후 1년 무상보증, 1년 이후 유상보증",
    "제품무상보증기간 : 준공일로부터 3년",
    "유상 보수 정비 요율 : 별도협의",
    "A/S 6개월 무상",
    "무 상 보 수 기 간 : 납품완료 후 12개월",
    "Warranty : 18개월",
]


def delivery_text() -> Column:
    w = F.col("quote_id") % 12 + 1
    return _pick(
        F.col("quote_id") % 5,
        [
            F.concat(F.lit("납기 : 발주 후 "), _text(w), F.lit("주 이내")),
            F.concat(F.lit("납기 : 계약 후 "), _text(w), F.lit("~"), _text(w + 2), F.lit("주")),
            F.lit("도입가능일 : 별도협의"),
            F.concat(F.lit("납기 "), _text(w * 5), F.lit("영업일")),
            F.concat(F.lit("리드타임 "), _text(w), F.lit("개월")),
        ],
    )


PAYMENT_LINES = ["결제조건 : 선입금 50%, 설치 후 50%", "결제조건은 현금결제", "대금 결제 조건: 발주시 30%", None]
VALIDITY_LINES = ["견적유효기간 : 견적일로부터 30일", "유효기간 2개월"]


def spec_text() -> Column:
    """Display specification; some sizes are implausible or belong to the cabinet."""
    k = F.col("quote_id")
    width = F.when(k % 5 == 0, 600 + k % 300).otherwise(1000 + k % 5000)
    height = 500 + k % 3000
    pitch = 10 + k % 30
    cabinet = F.when(k % 7 == 0, F.concat(F.lit(" / cabinet size "), _text(width), F.lit(" x "), _text(height)))
    return F.concat_ws(
        "",
        F.concat(F.lit("LED Display 전체화면 크기 "), _text(width), F.lit(" x "), _text(height), F.lit(" mm")),
        F.concat(F.lit(" / 해상도 "), _text(640 + k % 3000), F.lit(" x "), _text(400 + k % 2000)),
        F.concat(F.lit(" / Pixel Pitch "), F.expr("CAST((10 + quote_id % 30) div 10 AS STRING)"), F.lit("."), _text(pitch % 10)),
        F.concat(F.lit(" / 밝기 "), _text(300 + k % 900), F.lit(" nit")),
        F.concat(F.lit(" / Refresh Rate "), _text(60 + (k % 8) * 500), F.lit(" Hz")),
        F.when(k % 2 == 0, F.concat(F.lit(" / 최대소비전력 "), _text(1 + k % 9), F.lit(".5 kW"))).otherwise(
            F.concat(F.lit(" / 최대소비전력 "), _text(500 + k % 4000), F.lit(" W"))
        ),
        F.concat(F.lit(" / 베젤 "), _text(k % 60), F.lit(" mm")),
        cabinet,
    )


def vendor_of(k: Column) -> Column:
    """Supplier named in the document."""
    return F.format_string("Supplier#%09d", k % 40)


def quote_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quote_id, project_id, file_name, text, ...) one row per order."""
    k = F.col("quote_id")
    option = F.when(
        k % 4 == 0,
        F.concat(
            F.lit("옵션 2 "), won(F.col("supply") * 3), F.lit(" "), won(F.col("tax") * 3), F.lit(" "),
            won(F.col("supply") * 3 + F.col("tax") * 3),
        ),
    )
    site = F.concat(F.lit("현장 "), _text(F.col("project_id")), F.lit(" 구축"))
    return base(spark, sf_dir).select(
        "*",
        F.concat(
            F.lit("견적서_"), _text(k), F.lit("_"), vendor_of(k), F.when(k % 2 == 0, ".pdf").otherwise(".png")
        ).alias("file_name"),
        F.concat_ws(
            "\n",
            F.lit("견 적 서"),
            F.when(k % 3 == 0, F.concat_ws("\n", F.lit("상호명"), F.lit("대표자"), vendor_of(k))),
            F.when(k % 3 == 1, F.concat(F.lit("(주) "), vendor_of(k), F.lit(" 영업부"))),
            F.when(k % 2 == 0, F.concat(F.lit("건 명 : "), site)),
            F.concat(F.when(k % 8 == 7, F.lit("")).otherwise(F.lit("견적일자 : ")), date_text()),
            amount_text(),
            delivery_text(),
            _pick(k % 7, [F.lit(x) for x in WARRANTY_LINES]),
            _pick(k % 4, [F.lit(x) for x in PAYMENT_LINES]),
            _pick(k % 2, [F.lit(x) for x in VALIDITY_LINES]),
            spec_text(),
            F.lit("특기사항"),
            F.when(k % 3 == 0, F.lit("1. 전기 인입공사 별도")),
            F.when(k % 3 == 1, F.lit("- 현장실사 후 비용이 변경될 수 있습니다")),
            F.when(k % 2 == 1, F.lit("CMS 소프트웨어 미포함")),
            F.lit("품명"),
            option,
        ).alias("text"),
    )


def _cells(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def quote_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised tables: (quote_id, table_no, rows) with rows as arrays of cells.

    Table 1 carries a title row, a header, items with continuation rows, an overhead row
    and summary rows; table 2 of every third document has priced rows without a header.
    """
    k, s = F.col("quote_id"), F.col("supply")
    q = k % 4 + 1
    unit = F.expr("supply div 10")
    first = unit * q
    bracket = F.expr("supply div 20")
    overhead = F.expr("supply div 50")
    main = F.array(
        _cells("견적 상세", "", "", "", "", ""),
        _cells("NO", "품 명", "규격", "수량", "단가", "금액"),
        _cells("1", "LED 전광판", "P1.5 실내용", _text(q), won(unit), won(first)),
        _cells("", "", "함체 500 x 500", "", "", ""),
        _cells("", "", "밝기 800 nit", "", "", ""),
        _cells("2", "브라켓", "", "1", won(bracket), ""),
        _cells("", "", "스틸 제작형", "", "", won(bracket)),
        _cells("3", "관리비", "", "1", won(overhead), won(overhead)),
        _cells("", "합계", "", "", "", won(s)),
        _cells("", "부가세", "", "", "", won(F.col("tax"))),
    )
    second = F.array(
        _cells("설치비", "2 식", "", won(bracket)),
        _cells("케이블", "HDMI 10m", "3 EA", won(overhead)),
        _cells("비고", "별도", "", ""),
        _cells("소계", "1 식", "", won(bracket + overhead)),
    )
    tables = F.when(
        k % 3 == 0,
        F.array(F.struct(F.lit(1).alias("table_no"), main.alias("rows")), F.struct(F.lit(2).alias("table_no"), second.alias("rows"))),
    ).otherwise(F.array(F.struct(F.lit(1).alias("table_no"), main.alias("rows"))))
    return base(spark, sf_dir).select("quote_id", "supply", "tax", F.explode(tables).alias("t")).select(
        "quote_id", "supply", "tax", "t.table_no", "t.rows"
    )


def request_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label: value`` request forms, one per customer."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return spread(customers, "c_custkey").select(
        k.alias("project_id"),
        F.col("c_name").alias("company_name"),
        F.when(k % 5 == 0, "미입력").otherwise(F.concat(F.lit("지점 "), _text(F.col("c_nationkey")))).alias("location"),
        F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).cast("string")).alias("deadline"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("프로젝트명: 사업 "), _text(k)),
            F.concat(F.lit("활용 용도: "), _pick(k % 3, [F.lit("로비 안내"), F.lit("회의실"), F.lit("미입력")])),
            F.concat(F.lit("카테고리: "), _pick(k % 4, [F.lit("LED 전광판"), F.lit("비디오월"), F.lit("키오스크"), F.lit("없음")])),
            F.concat(F.lit("디스플레이 크기: "), F.when(k % 2 == 0, F.concat(_text(1000 + k % 5000), F.lit(" x "), _text(500 + k % 900), F.lit("mm"))).otherwise(F.lit("-"))),
            F.concat(F.lit("수량: "), _text(k % 9 + 1), F.lit("대")),
            F.concat(F.lit("예산 상한: "), _pick(k % 5, [
                F.concat(_text(k % 9 + 1), F.lit("억")), F.concat(_text(k % 50 + 1), F.lit("백만원")),
                F.concat(_text(k % 90 + 10), F.lit("00만원")), F.concat(F.format_number((k % 1000 + 1) * 10000, 0), F.lit("원")), F.lit("미입력"),
            ])),
            F.lit("담당: 무시되는 줄"),
            F.concat(F.lit("추가 요청사항: 야간 시공, 현장실사 "), _text(k % 3)),
            F.concat(F.lit("우선 검토 기준: "), F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("가격 우선"))),
        ).alias("request_text"),
    )


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text requests with numbered sections and product blocks, one per customer."""
    k = F.col("c_custkey")
    n = _text
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(
        k.alias("project_id"),
        F.concat_ws(
            "\n",
            F.when(k % 3 == 0, F.concat(F.lit("0. 수수료 모델 : A("), n(k % 7 + 3), F.lit("%)"))),
            F.concat(F.lit("1. 고객사 : 고객 "), n(k)),
            F.concat(F.lit("2. 견적 요청 내용 : 로비 개선"), F.when(k % 2 == 0, F.lit("\n 추가 설명")).otherwise(F.lit(""))),
            F.concat(F.lit("(1) LED 전광판 P"), n(k % 4 + 1), F.lit(".5 "), F.format_number(4000 + k % 900, 0), F.lit(" x "), F.format_number(2000 + k % 700, 0), F.lit("mm")),
            F.lit("커브드 타입"),
            F.when(k % 2 == 1, F.concat(F.lit("(2) 비디오월 55인치 "), n(k % 3 + 2), F.lit("x"), n(k % 4 + 2))),
            F.when(k % 4 != 0, F.concat(F.lit("3. 지역 : 지역 "), n(F.col("c_nationkey")))),
            F.concat(F.lit("4. 설치 일정 : "), n(k % 8 + 2), F.lit("주 이내")),
            F.concat(F.lit("5. 예산 : "), _pick(k % 4, [
                F.concat(n(k % 9 + 1), F.lit("천만원 이상 ~ "), n(k % 9 + 2), F.lit("천만원 미만")),
                F.concat(n(k % 9 + 1), F.lit("억 이하")), F.concat(F.lit("최대 "), n(k % 90 + 10), F.lit("만원")),
                F.concat(n(k % 9 + 1), F.lit("억원 이상")),
            ])),
            F.when(k % 5 == 0, F.lit("6. 단계 : 설계 검토")),
            F.lit("7. 기타 사항"),
            F.lit("- 현장실사 필요"),
            F.when(k % 2 == 0, F.lit("- 야간 작업")),
        ).alias("text"),
    )
