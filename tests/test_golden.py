"""Seed rows through every report, against the hand-derived outputs (FIXTURES §3)."""

from decimal import Decimal

from conftest import rows

from marquee.operators.audit import audit_all
from marquee.plans import cinema


def test_row_counts(seed):
    got = dict(rows(cinema.test_queries(seed)["row_counts"]))
    assert got == {"department_lookup": 5, "supervisors": 5, "employees": 20, "customers": 20, "theatres": 7,
                   "films": 10, "concessions": 20, "showings": 15, "orders": 10, "tickets": 15,
                   "order_concessions": 12, "shifts": 12}
    assert sum(got.values()) == 151


def test_dashboard(seed):
    d = cinema.dashboard(seed)
    assert rows(d["summary"]) == [(10, 15, 5, Decimal("236.24"))]
    recent = rows(d["recentOrders"], "order_number", "ticket_count")
    assert [r[0] for r in recent] == list(range(10, 0, -1))
    assert dict(recent) == {1: 2, 2: 1, 3: 2, 4: 1, 5: 2, 6: 1, 7: 2, 8: 1, 9: 2, 10: 1}
    assert [r[0] for r in rows(d["showings"], "showing_id")][:3] == [10, 5, 1]


def test_orders_tax_total(seed):
    got = rows(cinema.test_queries(seed)["order_summary"], "OrderNumber", "Subtotal", "Tax", "Discount", "OrderTotal")
    expect = {1: ("23.00", "1.84", "0.00", "24.84"), 3: ("30.00", "2.40", "2.00", "30.40"),
              7: ("24.00", "1.92", "3.00", "22.92"), 9: ("42.00", "3.36", "5.00", "40.36"),
              10: ("11.00", "0.88", "0.00", "11.88")}
    for n, sub, tax, disc, tot in got:
        if n in expect:
            assert (str(sub), str(tax), str(disc), str(tot)) == expect[n]


def test_top_films_and_concessions(seed):
    ov = cinema.overview(seed)
    assert rows(ov["topFilms"]) == [
        ("Dune: Part Three", 5), ("F1: The Movie", 2), ("How to Train Your Dragon", 2), ("Thunderbolts*", 2),
        ("Elio", 1), ("KPop Demon Hunters", 1), ("Lilo & Stitch", 1), ("Mission: Impossible - The Final Reckoning", 1)]
    sales = rows(ov["concessionSales"])
    assert sales[0] == ("Popcorn", "Large", 3)
    assert sum(r[2] for r in sales) == 19 and sum(1 for r in sales if r[2] == 0) == 9
    assert len(rows(ov["tickets"])) == 15 and len(rows(ov["shifts"])) == 12


def test_schedule_seats_sold(seed):
    s = cinema.test_queries(seed)["schedule"]
    assert s.count() == 15
    assert {r[0] for r in rows(s, "TheatreStatus")} == {"Open"}
    assert sum(r[0] for r in rows(s, "TicketsSold")) == 45


def test_roster(seed):
    r = rows(cinema.test_queries(seed)["roster"], "EmployeeID", "SupervisorName")
    assert len(r) == 20
    assert [e for e, s in r if s == "N/A"] == ["E12"]


def test_receipt_9_and_99(spark, seed):
    wanted = spark.createDataFrame([(9,), (99,)], "order_number bigint")
    rc = cinema.receipts(seed, wanted)
    assert rows(rc["header"], "order_number", "customer_name") == [(9, "James Wright")]
    assert rows(rc["lines"], "line_no", "label", "detail", "qty", "unit", "line") == [
        (1, "Tickets — Dune: Part Three", "2026-04-17T12:00:00", 1, Decimal("12.00"), Decimal("12.00")),
        (2, "Tickets — Thunderbolts*", "2026-04-17T13:00:00", 1, Decimal("12.00"), Decimal("12.00")),
        (3, "Popcorn (Large)", "Concession", 3, Decimal("9.00"), Decimal("27.00"))]
    assert rows(rc["missing"]) == [(99, "order_not_found")]


def test_receipt_line_sums(seed):
    lines = cinema.receipts(seed)["lines"]
    sums = {}
    for n, line in rows(lines, "order_number", "line"):
        sums[n] = sums.get(n, 0) + line
    assert {k: str(v) for k, v in sums.items()} == {
        1: "46.00", 2: "15.00", 3: "36.00", 4: "12.00", 5: "44.00", 6: "15.50", 7: "34.00", 8: "19.00",
        9: "51.00", 10: "15.00"}


def test_audits_clean_on_seed(seed):
    a = audit_all(seed)
    assert a["pk_duplicates"].count() == 0
    assert a["fk_orphans"].count() == 0
    assert a["null_audit"].where("null_count > 0").count() == 0


def test_audits_find_problems(spark, seed):
    t = dict(seed)
    t["tickets"] = seed["tickets"].unionByName(
        spark.createDataFrame([(1, "C999", 1, 1)], seed["tickets"].schema))
    a = audit_all(t)
    assert rows(a["pk_duplicates"], "table_name", "key_value", "n_rows") == [("tickets", "1", 2)]
    assert rows(a["fk_orphans"], "child_table", "fk_column", "key_value") == [
        ("tickets", "ticket_customer_id", "C999")]


def test_booking_labels(seed):
    opts = rows(cinema.booking(seed)["options"], "list_name", "value", "label")
    labels = {(k, v): l for k, v, l in opts}
    assert labels[("customers", "C001")] == "Ethan Walker (C001)"
    assert labels[("showings", "10")] == "Elio | Theatre 5 | 2026-04-17 10:00:00"
    assert labels[("concessions", "CN014")] == "Nachos (Medium) — $7.5"
    assert labels[("concessions", "CN001")] == "Popcorn (Regular) — $5"
    assert len(opts) == 20 + 15 + 20
