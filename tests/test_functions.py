from pyspark.sql import functions as F

from caisse.functions.payment import classify_payment, payment_text
from caisse.functions.text import (axis_label, date_display, format_eur, format_money, format_percent, normalize_question,
                                   short_label, strip_accents)


def one(spark, col, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(col).first()[0]


def test_money_and_percent(spark):
    assert one(spark, format_money("v"), 1234.5, "v double") == "1 234,50 €"
    assert one(spark, format_money("v"), -1234567.891, "v double") == "-1 234 567,89 €"
    assert one(spark, format_money("v"), None, "v double") == "0,00 €"
    assert one(spark, format_eur("v"), 10.0, "v double") == "10,00 EUR"
    assert one(spark, format_percent("v"), 12.345, "v double") == "12,3 %"
    assert one(spark, format_percent("v"), 1234.56, "v double") == "1234,6 %"


def test_accents(spark):
    assert one(spark, strip_accents("v"), "Éàçüñ Ÿ") == "Eacun Y"
    assert one(spark, normalize_question("v"), "Résumé du MOIS") == "resume du mois"


def test_payment_words(spark):
    cases = {"Payé": "paid", "Impayé": "unpaid", "En attente": "unpaid", "réglé": "paid", "unknown": "unpaid",
             "nouveau": "unpaid", "10": "paid", "True": "paid", "À vérifier": "unknown", "Réglé": "paid", "": "unknown",
             "oui": "paid", "Non payé": "unpaid"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r[0]: r[1] for r in df.select("v", classify_payment(payment_text("v", df.schema["v"].dataType))).collect()}
    assert got == cases


def test_payment_typed_values(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, None)], "n long, b boolean")
    got = df.select(classify_payment(payment_text("n", df.schema["n"].dataType)).alias("a"),
                    classify_payment(payment_text("b", df.schema["b"].dataType)).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("unknown", "paid"), ("paid", "unknown"), ("unknown", "unknown")]


def test_labels(spark):
    assert one(spark, axis_label("v"), 572332.27, "v double") == "572 k€"
    assert one(spark, axis_label("v"), 950.4, "v double") == "950 €"
    assert one(spark, short_label("v", 5), "abcdefg") == "abcd…"
    assert one(spark, date_display(F.to_timestamp("v")), "2024-03-05") == "05/03/2024"
    assert one(spark, date_display("v"), None, "v timestamp") == "-"
