"""Cinema binding: the 12 venue tables through every report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marquee.operators import receipts as R
from marquee.operators import reports as Q


def dashboard(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """P5."""
    return {
        "summary": Q.dashboard_summary(t["films"], t["showings"], t["theatres"], t["orders"]),
        "showings": Q.showing_schedule(t["showings"], t["films"]),
        "recentOrders": Q.recent_orders(t["orders"], t["customers"], t["tickets"]),
    }


def overview(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The 11 named sets of the management overview."""
    return {
        "customers": Q.customer_list(t["customers"]),
        "employees": Q.employee_list(t["employees"], t["department_lookup"]),
        "shifts": Q.shift_board(t["shifts"], t["employees"], t["department_lookup"]),
        "films": Q.film_list(t["films"]),
        "theatres": Q.theatre_list(t["theatres"]),
        "showings": Q.showing_schedule(t["showings"], t["films"]),
        "orders": Q.order_ledger(t["orders"], t["customers"]),
        "tickets": Q.ticket_detail(t["tickets"], t["customers"], t["showings"], t["films"]),
        "concessions": Q.concession_list(t["concessions"]),
        "topFilms": Q.top_films(t["tickets"], t["showings"], t["films"]),
        "concessionSales": Q.concession_units(t["concessions"], t["order_concessions"]),
    }


def customer_directory(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """P7."""
    return {"customers": Q.customer_directory(t["customers"]), "count": Q.directory_count(t["customers"])}


def booking(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """P8."""
    return {
        "customers": Q.booking_customers(t["customers"]),
        "showings": Q.showing_schedule(t["showings"], t["films"]),
        "concessions": Q.booking_concessions(t["concessions"]),
        "options": Q.booking_options(t["customers"], t["showings"], t["films"], t["concessions"]),
    }


def test_queries(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The reference's validation queries."""
    return {
        "roster": Q.roster_by_department(t["employees"], t["department_lookup"], t["supervisors"]),
        "schedule": Q.schedule_with_seats(t["showings"], t["films"], t["theatres"]),
        "order_summary": Q.order_summary(t["orders"], t["customers"]),
        "row_counts": Q.table_row_counts(t),
    }


def receipts(t: dict[str, DataFrame], wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """P4 for a set of orders (all when ``wanted`` is None)."""
    tickets = R.receipt_ticket_lines(t["tickets"], t["showings"], t["films"], wanted)
    items = R.receipt_item_lines(t["order_concessions"], t["concessions"], wanted)
    out = {"header": R.receipt_header(t["orders"], t["customers"], wanted),
           "lines": R.receipt_lines(tickets, items, R.line_bounds(t["tickets"], t["order_concessions"], wanted))}
    if wanted is not None:
        out["missing"] = R.missing_receipts(t["orders"], t["customers"], wanted)
    return out
