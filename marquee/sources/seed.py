"""A3: the seed rows of the venue model.

Fixed values: these rows must equal the reference's seed data for the golden
outputs to hold.  Stored in natural order, parents before children.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

# ---- fixed values (seed data) ------------------------------------------------
DEPARTMENTS = [
    (1, "Box Office"), (2, "Concessions"), (3, "Cleaning"), (4, "Projection"), (5, "Management"),
]

SUPERVISORS = [
    (1, "Patricia", "Olsen", 5), (2, "Marcus", "Chen", 4), (3, "Elena", "Rodriguez", 2),
    (4, "James", "Whitaker", 1), (5, "Sonya", "Patel", 3),
]

EMPLOYEES = [
    ("E01", "Margo", "Elia", "margo.elia@mail.com", "Usher", "Full time", 4, 1),
    ("E02", "Orso", "Bernardetta", "orso.bernardetta@mail.com", "Custodian", "Part time", 5, 3),
    ("E03", "Teodora", "De Luca", "teodora.deluca@mail.com", "Projection Assistant", "Full time", 2, 4),
    ("E04", "Lisandro", "Agresta", "lisandro.agresta@mail.com", "Box Office Associate", "Full time", 4, 1),
    ("E05", "Mesut", "Demirci", "mesut.demirci@mail.com", "Projectionist", "Full time", 2, 4),
    ("E06", "Enis", "Terzi", "enis.terzi@mail.com", "Concessions Associate", "Part time", 3, 2),
    ("E07", "Dominga", "Aguilar Pineda", "dominga.aguilar@mail.com", "Concessions Associate", "Full time", 3, 2),
    ("E08", "Maria", "Rana", "maria.rana@mail.com", "Payroll Specialist", "Full time", 1, 5),
    ("E09", "Janet", "Choi", "janet.choi@mail.com", "Projection Assistant", "Full time", 2, 4),
    ("E10", "Daniel", "Cross", "danny.cross@gmail.com", "Usher", "Part time", 4, 1),
    ("E11", "Mina", "Villalobos", "mina.villalobos@mail.com", "Cinema Assistant Manager", "Full time", 1, 5),
    ("E12", "Patricia", "Olsen", "patricia.olsen@mail.com", "Cinema Manager", "Full time", None, 5),
    ("E13", "Marcus", "Chen", "marcus.chen@mail.com", "Department Supervisor", "Full time", 1, 4),
    ("E14", "Elena", "Rodriguez", "elena.rodriguez@mail.com", "Department Supervisor", "Full time", 1, 2),
    ("E15", "James", "Whitaker", "james.whitaker@mail.com", "Department Supervisor", "Full time", 1, 1),
    ("E16", "Sonya", "Patel", "sonya.patel@mail.com", "Department Supervisor", "Full time", 1, 3),
    ("E17", "Yawen", "Qiu", "yawen.qui@mail.com", "Customer Service Representative", "Full time", 4, 1),
    ("E18", "Farzana", "Sherazi", "farzana.sherazi@mail.com", "Box Office Shift Lead", "Full time", 4, 1),
    ("E19", "Aydan", "Karga", "aydan.karga@mail.com", "Usher", "Part time", 4, 1),
    ("E20", "Benjamin", "Hart", "ben.hart@mail.com", "Custodian", "Part time", 5, 3),
]

CUSTOMERS = [
    ("C001", "Ethan", "Walker", "ethan.walker@mail.com", "3155551001", 28, "M", "Syracuse", True, "Credit Card"),
    ("C002", "Olivia", "Harris", "olivia.harris@mail.com", "3155551002", 24, "F", "Buffalo", False, "Debit Card"),
    ("C003", "Noah", "Clark", "noah.clark@mail.com", "3155551003", 32, "M", "Albany", True, "Credit Card"),
    ("C004", "Ava", "Lewis", "ava.lewis@mail.com", "3155551004", 21, "F", "NYC", False, "Cash"),
    ("C005", "Liam", "Hall", "liam.hall@mail.com", "3155551005", 35, "M", "Rochester", True, "Credit Card"),
    ("C006", "Sophia", "Allen", "sophia.allen@mail.com", "3155551006", 27, "F", "Syracuse", True, "Mobile Pay"),
    ("C007", "Mason", "Young", "mason.young@mail.com", "3155551007", 30, "M", "Utica", False, "Cash"),
    ("C008", "Isabella", "King", "isabella.king@mail.com", "3155551008", 22, "F", "Ithaca", False, "Debit Card"),
    ("C009", "James", "Wright", "james.wright@mail.com", "3155551009", 40, "M", "NYC", True, "Credit Card"),
    ("C010", "Mia", "Scott", "mia.scott@mail.com", "3155551010", 26, "F", "Syracuse", True, "Mobile Pay"),
    ("C011", "Benjamin", "Green", "ben.green@mail.com", "3155551011", 34, "M", "Buffalo", False, "Cash"),
    ("C012", "Charlotte", "Adams", "charlotte.adams@mail.com", "3155551012", 23, "F", "Albany", False, "Debit Card"),
    ("C013", "Lucas", "Baker", "lucas.baker@mail.com", "3155551013", 31, "M", "Rochester", True, "Credit Card"),
    ("C014", "Amelia", "Nelson", "amelia.nelson@mail.com", "3155551014", 25, "F", "Syracuse", True, "Mobile Pay"),
    ("C015", "Henry", "Carter", "henry.carter@mail.com", "3155551015", 37, "M", "NYC", False, "Cash"),
    ("C016", "Harper", "Mitchell", "harper.mitchell@mail.com", "3155551016", 29, "F", "Buffalo", False, "Debit Card"),
    ("C017", "Alexander", "Perez", "alex.perez@mail.com", "3155551017", 33, "M", "Albany", True, "Credit Card"),
    ("C018", "Evelyn", "Roberts", "evelyn.roberts@mail.com", "3155551018", 20, "F", "Ithaca", False, "Cash"),
    ("C019", "Daniel", "Turner", "daniel.turner@mail.com", "3155551019", 41, "M", "Syracuse", True, "Credit Card"),
    ("C020", "Abigail", "Phillips", "abigail.phillips@mail.com", "3155551020", 28, "F", "Rochester", False, "Debit Card"),
]

THEATRES = [
    (1, 40, True, True, None),
    (2, 40, False, False, "Renovations scheduled for April-June"),
    (3, 40, False, True, None),
    (4, 40, False, True, None),
    (5, 25, True, True, None),
    (6, 56, True, True, None),
    (7, 56, True, False, "Replacement projector to be installed 4/30; contact Marcus Chen with any questions"),
]

FILMS = [
    (1, "Dune: Part Three", "PG-13", 165, "English", "2026-04-20"),
    (2, "Thunderbolts*", "PG-13", 127, "English", "2026-04-18"),
    (3, "How to Train Your Dragon", "PG", 126, "English", "2026-04-22"),
    (4, "Lilo & Stitch", "PG", 108, "English", "2026-04-19"),
    (5, "F1: The Movie", "PG-13", 155, "English", "2026-04-21"),
    (6, "Mission: Impossible - The Final Reckoning", "PG-13", 169, "English", "2026-04-23"),
    (7, "Elio", "PG", 98, "English", "2026-04-17"),
    (8, "KPop Demon Hunters", "PG", 110, "English", "2026-04-24"),
    (9, "Ballerina", "R", 109, "English", "2026-04-16"),
    (10, "Weapons", "R", 134, "English", "2026-04-25"),
]

CONCESSIONS = [
    ("CN001", "Popcorn", "Regular", "Snacks", "5.00"),
    ("CN002", "Popcorn", "Medium", "Snacks", "7.00"),
    ("CN003", "Popcorn", "Large", "Snacks", "9.00"),
    ("CN004", "Coke", "Regular", "Beverage", "3.00"),
    ("CN005", "Coke", "Medium", "Beverage", "4.00"),
    ("CN006", "Coke", "Large", "Beverage", "5.00"),
    ("CN007", "Pepsi", "Regular", "Beverage", "3.00"),
    ("CN008", "Pepsi", "Medium", "Beverage", "4.00"),
    ("CN009", "Pepsi", "Large", "Beverage", "5.00"),
    ("CN010", "Pizza", "Regular", "Fast Food", "8.00"),
    ("CN011", "Pizza", "Medium", "Fast Food", "10.00"),
    ("CN012", "Pizza", "Large", "Fast Food", "12.00"),
    ("CN013", "Nachos", "Regular", "Snacks", "6.00"),
    ("CN014", "Nachos", "Medium", "Snacks", "7.50"),
    ("CN015", "Nachos", "Large", "Snacks", "9.00"),
    ("CN016", "French Fries", "Regular", "Fast Food", "4.00"),
    ("CN017", "French Fries", "Medium", "Fast Food", "5.50"),
    ("CN018", "French Fries", "Large", "Fast Food", "7.00"),
    ("CN019", "Ice Cream", "Regular", "Dessert", "3.50"),
    ("CN020", "Ice Cream", "Medium", "Dessert", "4.50"),
]

SHOWINGS = [
    (1, 1, 6, "2026-04-17T12:00:00", 50),
    (2, 1, 6, "2026-04-17T16:00:00", 42),
    (3, 2, 4, "2026-04-17T13:00:00", 35),
    (4, 2, 4, "2026-04-17T18:30:00", 40),
    (5, 3, 1, "2026-04-17T11:00:00", 38),
    (6, 3, 1, "2026-04-17T15:00:00", 40),
    (7, 4, 5, "2026-04-17T14:00:00", 20),
    (8, 5, 6, "2026-04-17T19:00:00", 56),
    (9, 6, 3, "2026-04-17T17:00:00", 33),
    (10, 7, 5, "2026-04-17T10:00:00", 25),
    (11, 8, 3, "2026-04-17T20:00:00", 40),
    (12, 9, 4, "2026-04-17T21:00:00", 36),
    (13, 10, 6, "2026-04-17T21:30:00", 54),
    (14, 4, 1, "2026-04-18T13:00:00", 40),
    (15, 5, 3, "2026-04-18T15:30:00", 40),
]

TICKETS = [
    (1, "C001", 1, 1), (2, "C001", 1, 1), (3, "C002", 3, 2), (4, "C003", 5, 3), (5, "C003", 5, 3),
    (6, "C004", 7, 4), (7, "C005", 8, 5), (8, "C005", 8, 5), (9, "C006", 10, 6), (10, "C007", 2, 7),
    (11, "C007", 2, 7), (12, "C008", 9, 8), (13, "C009", 1, 9), (14, "C009", 3, 9), (15, "C010", 11, 10),
]

ORDER_CONCESSIONS = [
    (1, "CN002", 2), (1, "CN005", 2), (2, "CN004", 1), (3, "CN013", 2), (5, "CN011", 1), (5, "CN006", 2),
    (6, "CN019", 1), (7, "CN001", 2), (8, "CN016", 1), (8, "CN004", 1), (9, "CN003", 3), (10, "CN007", 1),
]

SHIFTS = [
    (1, "E04", 1, "2026-04-17T11:00:00", "2026-04-17T15:00:00", 1),
    (2, "E18", 3, "2026-04-17T12:00:00", "2026-04-17T16:00:00", 1),
    (3, "E17", 5, "2026-04-17T10:00:00", "2026-04-17T14:00:00", 1),
    (4, "E05", 1, "2026-04-17T11:30:00", "2026-04-17T15:00:00", 4),
    (5, "E03", 3, "2026-04-17T12:30:00", "2026-04-17T16:00:00", 4),
    (6, "E09", 7, "2026-04-17T13:30:00", "2026-04-17T17:00:00", 4),
    (7, "E01", 1, "2026-04-17T11:45:00", "2026-04-17T15:15:00", 1),
    (8, "E10", 8, "2026-04-17T18:30:00", "2026-04-17T22:30:00", 1),
    (9, "E19", 9, "2026-04-17T16:30:00", "2026-04-17T20:30:00", 1),
    (10, "E06", None, "2026-04-17T10:00:00", "2026-04-17T16:00:00", 2),
    (11, "E07", None, "2026-04-17T14:00:00", "2026-04-17T22:00:00", 2),
    (12, "E02", None, "2026-04-17T21:00:00", "2026-04-18T01:00:00", 3),
]

# (order_number, customer_id, subtotal, discount); tax and total are derived.
ORDER_SOURCE = [
    (1, "C001", "23.00", "0.00"), (2, "C002", "16.00", "0.00"), (3, "C003", "30.00", "2.00"),
    (4, "C004", "12.00", "0.00"), (5, "C005", "37.00", "0.00"), (6, "C006", "14.00", "0.00"),
    (7, "C007", "24.00", "3.00"), (8, "C008", "19.00", "0.00"), (9, "C009", "42.00", "5.00"),
    (10, "C010", "11.00", "0.00"),
]
SEED_ORDER_CREATED_AT = "2026-04-17T18:00:00"
# ---- end of fixed values -------------------------------------------------------


def _ts(text):
    return None if text is None else _dt.datetime.fromisoformat(text)


def _date(text):
    return None if text is None else _dt.date.fromisoformat(text)


def seed_rows() -> dict[str, list[tuple]]:
    """Seed rows typed for :data:`marquee.schema.SCHEMAS` (orders without tax/total yet)."""
    return {
        "department_lookup": DEPARTMENTS,
        "supervisors": SUPERVISORS,
        "employees": EMPLOYEES,
        "customers": CUSTOMERS,
        "theatres": THEATRES,
        "films": [r[:5] + (_date(r[5]),) for r in FILMS],
        "concessions": [r[:4] + (Decimal(r[4]),) for r in CONCESSIONS],
        "showings": [r[:3] + (_ts(r[3]), r[4]) for r in SHOWINGS],
        "tickets": TICKETS,
        "order_concessions": ORDER_CONCESSIONS,
        "shifts": [r[:3] + (_ts(r[3]), _ts(r[4]), r[5]) for r in SHIFTS],
    }
