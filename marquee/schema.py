"""A2: the 12 venue tables -- types, null rules, defaults and keys.

Types follow the strict (decimal) dialect of the reference model: money is
DECIMAL(10,2), flags are booleans, times carry no zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
TS, D = T.TimestampNTZType(), T.DateType()

SCHEMAS: dict[str, T.StructType] = {
    "department_lookup": T.StructType([_f("department_id", I), _f("department_name", S)]),
    "supervisors": T.StructType([_f("supervisor_id", I), _f("firstname", S), _f("lastname", S),
                                 _f("department_id", I)]),
    "employees": T.StructType([_f("employee_id", S), _f("firstname", S), _f("lastname", S), _f("email", S),
                               _f("job_title", S), _f("status", S), _f("supervisor_id", I, True),
                               _f("department_id", I)]),
    "customers": T.StructType([_f("customer_id", S), _f("firstname", S), _f("lastname", S), _f("email", S),
                               _f("phone", S, True), _f("age", I, True), _f("gender", S, True),
                               _f("home_city", S, True), _f("rewards_member", B),
                               _f("pref_pymt_method", S, True)]),
    "theatres": T.StructType([_f("theatre_number", I), _f("theatre_seat_count", I), _f("accessible_seating", B),
                              _f("status", B), _f("status_notes", S, True)]),
    "films": T.StructType([_f("film_id", I), _f("film_title", S), _f("film_rating", S),
                           _f("film_length_minutes", I), _f("film_language", S),
                           _f("film_last_showing_date", D, True)]),
    "showings": T.StructType([_f("showing_id", I), _f("film_id", I), _f("film_theatre_number", I),
                              _f("film_showing_datetime", TS), _f("film_available_seats", I)]),
    "orders": T.StructType([_f("order_number", L), _f("order_customer_id", S), _f("subtotal", MONEY),
                            _f("tax", MONEY), _f("discount", MONEY, True), _f("total", MONEY),
                            _f("created_at", TS)]),
    "tickets": T.StructType([_f("ticket_id", L), _f("ticket_customer_id", S), _f("ticket_showing_id", I),
                             _f("ticket_order_number", L)]),
    "shifts": T.StructType([_f("shift_id", L), _f("employee_id", S), _f("showing_id", I, True),
                            _f("shift_start_datetime", TS), _f("shift_end_datetime", TS),
                            _f("shift_department_id", I)]),
    "concessions": T.StructType([_f("concession_id", S), _f("concession_name", S), _f("concession_size", S, True),
                                 _f("concession_type", S, True), _f("concession_price", MONEY)]),
    "order_concessions": T.StructType([_f("order_number", L), _f("concession_id", S), _f("quantity", I)]),
}

# Parents before children: the load order.  Drops run in reverse.
LOAD_ORDER = ["department_lookup", "supervisors", "employees", "customers", "theatres", "films",
              "concessions", "showings", "orders", "tickets", "order_concessions", "shifts"]

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "department_lookup": ("department_id",),
    "supervisors": ("supervisor_id",),
    "employees": ("employee_id",),
    "customers": ("customer_id",),
    "theatres": ("theatre_number",),
    "films": ("film_id",),
    "showings": ("showing_id",),
    "orders": ("order_number",),
    "tickets": ("ticket_id",),
    "shifts": ("shift_id",),
    "concessions": ("concession_id",),
    "order_concessions": ("order_number", "concession_id"),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str


FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("supervisors", "department_id", "department_lookup", "department_id"),
    ForeignKey("employees", "supervisor_id", "supervisors", "supervisor_id"),
    ForeignKey("employees", "department_id", "department_lookup", "department_id"),
    ForeignKey("showings", "film_id", "films", "film_id"),
    ForeignKey("showings", "film_theatre_number", "theatres", "theatre_number"),
    ForeignKey("orders", "order_customer_id", "customers", "customer_id"),
    ForeignKey("tickets", "ticket_customer_id", "customers", "customer_id"),
    ForeignKey("tickets", "ticket_showing_id", "showings", "showing_id"),
    ForeignKey("tickets", "ticket_order_number", "orders", "order_number"),
    ForeignKey("shifts", "employee_id", "employees", "employee_id"),
    ForeignKey("shifts", "showing_id", "showings", "showing_id"),
    ForeignKey("shifts", "shift_department_id", "department_lookup", "department_id"),
    ForeignKey("order_concessions", "order_number", "orders", "order_number"),
    ForeignKey("order_concessions", "concession_id", "concessions", "concession_id"),
]

# Column defaults applied when an appended row leaves the column out.
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"rewards_member": False},
    "theatres": {"accessible_seating": False, "status": True},
    "order_concessions": {"quantity": 1},
}


def required_columns(table: str) -> list[str]:
    """NOT NULL columns of a table."""
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
