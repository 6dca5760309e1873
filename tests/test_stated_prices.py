"""Prices named on a card are compared in the unit they are named in."""

import pytest

from quotelake.operators.evaluate import card_violations, category_counts, violation_rates

CARD = "record_id string, quote_id string, vendor_name string, card_summary string, strengths array<string>, weaknesses array<string>"
ITEM = ("record_id string, quote_id string, vendor_name string, check_required array<string>, warranty_months int, "
        "total_supply_price long, total_with_vat long, delivery_weeks int")


@pytest.mark.parametrize("said,supply,guessed", [
    ("금액 1,234원", 12345678, True), ("금액 1,234만원", 12345678, False), ("금액 12,345,678원", 12345678, False),
    ("금액 12345678만원", 12345678, True), ("금액 1,235만원", 12345678, True), ("금액 1,234원", 1234, False),
    ("금액 0원", 0, True), ("금액 1원", None, True), ("금액 99999999999999999999원", 5, False), ("금액 없음", 5, False),
])
def test_price_guess(spark, said, supply, guessed):
    cards = spark.createDataFrame([("r", "q", "업체", said, ["가"], ["나"])], CARD)
    items = spark.createDataFrame([("r", "q", "업체", [], 12, supply, None, 3)], ITEM)
    assert ("price_guess" in card_violations(cards, items).first().categories) == guessed


def checked(spark):
    cards = spark.createDataFrame([("r", "q", "업체", "금액 1,234원", ["가"], ["나"])], CARD)
    return card_violations(cards, spark.createDataFrame([("r", "q", "업체", [], 12, 12345678, None, 3)], ITEM))


def test_price_guess_is_counted(spark):
    assert [tuple(r) for r in category_counts(checked(spark), "record_id").collect()] == [("r", "price_guess", 1)]


def test_price_guess_enters_the_rate(spark):
    r = violation_rates(checked(spark), "record_id").first()
    assert (r.violations_raw, r.violation_rate_primary) == (1, 1.0)
