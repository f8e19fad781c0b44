"""Order and customer intake on the seed, with the edge cases of FIXTURES §2."""

import datetime as dt
import json
from decimal import Decimal

from conftest import rows

from marquee.operators import customers as CU
from marquee.operators import orders as OR
from marquee.sources.requests import parse_bodies

T0 = dt.datetime(2026, 4, 17, 9, 0, 0)


def _requests(spark, bodies):
    data = [(i + 1, T0 + dt.timedelta(seconds=i), b if isinstance(b, str) else json.dumps(b))
            for i, b in enumerate(bodies)]
    return parse_bodies(spark.createDataFrame(data, "request_id bigint, arrived_at timestamp_ntz, body string"))


def _orders(spark, seed, bodies):
    return OR.intake(_requests(spark, bodies), seed["customers"], seed["showings"], seed["concessions"],
                     seed["orders"], seed["tickets"])


def _reasons(out):
    return dict(rows(out["decisions"], "request_id", "reason"))


def test_static_checks(spark, seed):
    out = _orders(spark, seed, [
        {"customerId": "C001", "showingId": 1},                       # qty missing
        {"customerId": "C001", "showingId": 1, "ticketQty": None},
        {"customerId": "C001", "showingId": 1, "ticketQty": "x"},
        {"customerId": "C001", "showingId": 1, "ticketQty": "2.7"},
        "not json at all",
        {"showingId": 1, "ticketQty": "x"},                            # bad number beats missing customer
        {"customerId": "C404", "showingId": 1, "ticketQty": 1},
        {"customerId": "C001", "showingId": 99, "ticketQty": 1},
        {"customerId": "", "showingId": 1, "ticketQty": 1},
    ])
    assert _reasons(out) == {1: "showing_and_qty_required", 2: "bad_number", 3: "bad_number", 4: "bad_number",
                             5: "customer_required", 6: "bad_number", 7: "customer_not_found",
                             8: "showing_not_found", 9: "customer_required"}
    assert out["orders"].count() == 0 and out["tickets"].count() == 0


def test_number_coercion(spark, seed):
    out = _orders(spark, seed, [{"customerId": "C002", "showingId": 1, "ticketQty": 2.7},
                                {"customerId": "C002", "showingId": "1", "ticketQty": "3"},
                                {"customerId": "C002", "showingId": 1, "ticketQty": True}])
    got = rows(out["decisions"].orderBy("request_id"), "status", "ticket_qty")
    assert got == [("accepted", 2), ("accepted", 3), ("accepted", 1)]


def test_one_oversized_request_harms_no_other(spark, seed):
    far = {"id": "CN001", "qty": 20_000_000}
    out = _orders(spark, seed, [{"customerId": "C002", "showingId": 1, "ticketQty": 1},
                                {"customerId": "C002", "showingId": 1, "ticketQty": 10_000_000},
                                {"customerId": "C404", "showingId": 1, "ticketQty": 10_000_000},
                                {"customerId": "C002", "showingId": 1, "ticketQty": 1, "concessions": [far]},
                                {"customerId": "C002", "showingId": 1, "ticketQty": 9_007_199_254_740_993},
                                {"customerId": "C002", "showingId": 1, "ticketQty": 1e30},
                                {"customerId": "C002", "showingId": 1, "ticketQty": "1_0"},
                                {"customerId": "C002", "showingId": 9_007_199_254_740_993, "ticketQty": 1}])
    assert _reasons(out) == {1: None, 2: "not_enough_seats", 3: "customer_not_found", 4: "amount_too_large", 5: "not_enough_seats",
                             6: "not_enough_seats", 7: None, 8: "showing_not_found"}
    got = {r["request_id"]: r for r in out["decisions"].collect()}
    assert got[5]["ticket_qty"] == 9_007_199_254_740_993 and got[8]["showing_id"] == 9_007_199_254_740_993
    assert out["orders"].count() == 2 and out["tickets"].count() == 11


def test_seat_race_on_showing_7(spark, seed):
    out = _orders(spark, seed, [{"customerId": "C002", "showingId": 7, "ticketQty": 12},
                                {"customerId": "C004", "showingId": 7, "ticketQty": 12},
                                {"customerId": "C004", "showingId": 7, "ticketQty": 8}])
    assert _reasons(out) == {1: None, 2: "not_enough_seats", 3: None}
    seats = dict(rows(out["seats"], "showing_id", "film_available_seats"))
    assert seats[7] == 0 and seats[1] == 50
    assert rows(out["orders"].orderBy("order_number"), "order_number") == [(11,), (12,)]
    assert [r[0] for r in rows(out["tickets"].orderBy("ticket_id"), "ticket_id")] == list(range(16, 36))


def test_pricing_member_and_items(spark, seed):
    out = _orders(spark, seed, [
        {"customerId": "C001", "showingId": 1, "ticketQty": 2},
        {"customerId": "C002", "showingId": 1, "ticketQty": 1, "concessions": [{"id": "CN014", "qty": 2}]},
        {"customerId": "C002", "showingId": 1, "ticketQty": 1,
         "concessions": [{"id": "CN001", "qty": 0}, {"id": "CN001", "qty": "x"}, {"qty": 2}, {"id": "ZZZ", "qty": 1},
                         {"id": "CN003", "qty": 1}]},
    ])
    d = {r[0]: r[1:] for r in rows(out["decisions"], "request_id", "subtotal", "discount", "tax", "total",
                                   "rewards_discount_applied")}
    assert d[1] == (Decimal("24.00"), Decimal("2.40"), Decimal("1.92"), Decimal("23.52"), True)
    assert d[2] == (Decimal("27.00"), Decimal("0.00"), Decimal("2.16"), Decimal("29.16"), False)
    assert d[3][0] == Decimal("21.00")
    items = sorted(rows(out["items"], "order_number", "concession_id", "quantity"))
    assert items == [(12, "CN014", 2), (13, "CN003", 1)]


def test_duplicate_and_broken_items_take_no_seats(spark, seed):
    out = _orders(spark, seed, [
        {"customerId": "C001", "showingId": 7, "ticketQty": 15,
         "concessions": [{"id": "CN001", "qty": 1}, {"id": "CN001", "qty": 2}]},
        {"customerId": "C001", "showingId": 7, "ticketQty": 15, "concessions": [3]},
        {"customerId": "C001", "showingId": 7, "ticketQty": 21,
         "concessions": [{"id": "CN001", "qty": 1}, {"id": "CN001", "qty": 2}]},
        {"customerId": "C001", "showingId": 7, "ticketQty": 20},
    ])
    assert _reasons(out) == {1: "duplicate_concession", 2: "bad_concessions", 3: "not_enough_seats", 4: None}
    assert dict(rows(out["seats"], "showing_id", "film_available_seats"))[7] == 0


def test_one_request_id_sent_twice_is_two_requests(spark, seed):
    body = json.dumps({"customerId": "C002", "showingId": 7, "ticketQty": 9, "concessions": [{"id": "CN001", "qty": 1}, {"id": "CN003", "qty": 2}]})
    data = [(5, T0, body), (5, T0 + dt.timedelta(seconds=1), body), (5, T0 + dt.timedelta(seconds=2), body), (6, T0 + dt.timedelta(seconds=3), body.replace("9", "1")),
            (6, T0 + dt.timedelta(seconds=3), body.replace("9", "1"))]
    req = parse_bodies(spark.createDataFrame(data, "request_id bigint, arrived_at timestamp_ntz, body string"))
    out = OR.intake(req, seed["customers"], seed["showings"], seed["concessions"], seed["orders"], seed["tickets"])
    got = rows(out["decisions"].orderBy("arrived_at", "order_number"), "request_id", "reason", "order_number")
    assert got == [(5, None, 11), (5, None, 12), (5, "not_enough_seats", None), (6, None, 13), (6, None, 14)]
    assert out["tickets"].count() == 20 and out["tickets"].select("ticket_id").distinct().count() == 20
    assert sorted(rows(out["items"], "order_number", "concession_id", "quantity")) == [(n, c, q) for n in (11, 12, 13, 14) for c, q in (("CN001", 1), ("CN003", 2))]
    mail = [(1, T0 + dt.timedelta(seconds=i), json.dumps({"name": "A", "email": e})) for i, e in enumerate(["a@x", "A@x", "b@x"])]
    req = parse_bodies(spark.createDataFrame(mail, "request_id bigint, arrived_at timestamp_ntz, body string"))
    got = rows(CU.intake_customers(req, seed["customers"])["decisions"].orderBy("arrived_at"), "reason", "customer_id")
    assert got == [(None, "C021"), ("duplicate_email", "C021"), (None, "C022")]


def test_answers_to_all_requests(spark, seed):
    item = {"id": "CN001", "qty": 1}
    out = _orders(spark, seed, [{"customerId": "C002", "showingId": 1, "ticketQty": "x"}, {"showingId": 1, "ticketQty": 1}, {"customerId": "C002"},
                                {"customerId": "C404", "showingId": 1, "ticketQty": 1}, {"customerId": "C002", "showingId": 99, "ticketQty": 1},
                                {"customerId": "C002", "showingId": 7, "ticketQty": 999}, {"customerId": "C002", "showingId": 7, "ticketQty": 1, "concessions": [item, item]},
                                {"customerId": "C002", "showingId": 7, "ticketQty": 1}])
    got = rows(out["answers"].orderBy("request_id"), "http_status", "error", "orderNumber", "receiptUrl")
    assert got == [(400, "Showing and ticket quantity must be valid numbers.", None, None), (400, "Customer is required.", None, None),
                   (400, "Showing and ticket quantity are required.", None, None), (404, "Customer not found.", None, None), (404, "Showing not found.", None, None),
                   (400, "Not enough seats available for this showing.", None, None), (500, None, None, None), (201, None, 11, "/receipt/11")]
    out = _customers(spark, seed, [{"name": "A"}, {"name": "Dupe", "email": "ETHAN.WALKER@mail.com"}, {"name": "Ana B", "email": "ana@x"}])
    got = rows(out["answers"].orderBy("request_id"), "http_status", "error", "customerId", "firstname", "email")
    assert got == [(400, "Email is required.", None, None, None), (409, "A customer with that email already exists.", "C001", None, None), (201, None, "C021", "Ana", "ana@x")]


def _customers(spark, seed, bodies, existing=None):
    return CU.intake_customers(_requests(spark, bodies), existing if existing is not None else seed["customers"])


def test_customer_names_and_ids(spark, seed):
    out = _customers(spark, seed, [
        {"name": "   ", "email": "guest@x.com"},
        {"name": "Cher", "email": "cher@x.com"},
        {"name": "Ana  de la Cruz", "email": "ana@x.com", "rewardsMember": True},
        {"firstName": "Solo", "email": "solo@x.com"},
        {"name": "Nobody", "email": "  "},
        {"name": "Dupe", "email": "ETHAN.WALKER@mail.com"},
        {"name": "Again", "email": "CHER@X.COM"},
    ])
    got = {r[0]: r[1:] for r in rows(out["decisions"], "request_id", "status", "reason", "customer_id", "firstname",
                                     "lastname", "rewards_member")}
    assert got[1] == ("accepted", None, "C021", "Guest", "Customer", False)
    assert got[2] == ("accepted", None, "C022", "Cher", "Customer", False)
    assert got[3] == ("accepted", None, "C023", "Ana", "de la Cruz", True)
    assert got[4] == ("accepted", None, "C024", "Solo", "Customer", False)
    assert got[5][:3] == ("refused", "email_required", None)
    assert got[6][:3] == ("refused", "duplicate_email", "C001")
    assert got[7][:3] == ("refused", "duplicate_email", "C022")
    assert out["customers"].count() == 4


def test_next_id_edges(spark, seed):
    many = spark.createDataFrame([("C999", "a@x"), ("X5", "b@x"), ("C12a", "c@x")], "customer_id string, email string")
    assert rows(CU.max_customer_number(many)) == [(999, "C1000")]
    none = spark.createDataFrame([("X5", "b@x")], "customer_id string, email string")
    assert rows(CU.max_customer_number(none)) == [(0, "C001")]


def test_first_holder_is_the_lowest_number(spark):
    c = spark.createDataFrame([("X9", "a@x"), ("C010", "A@x"), ("C001", "a@X")], "customer_id string, email string")
    assert rows(CU.email_holders(c), "email_key", "holder_id") == [("a@x", "C001")]
