"""Reports over the venue model (P5-P12; D*, E*, C1-C11).

Every function takes DataFrames that carry the venue column names and returns
an ordered DataFrame.  Orderings always end on the primary key so ties are
deterministic.  Aggregates are computed before joining wherever the grouping
key is a join key (Catalyst does not push an aggregate below a join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import columns as C
from marquee.functions.money import with_order_totals

#: Orders looked up next when the newest ones have no customer (so many times more), and the most that are broadcast.
DEEPER, MANY_ORDERS = 16, 100_000


def _count(df: DataFrame):
    return df.select(F.count(F.lit(1))).scalar()


def dashboard_summary(films: DataFrame, showings: DataFrame, theatres: DataFrame,
                      orders: DataFrame) -> DataFrame:
    """One row of four uncorrelated scalar aggregates."""
    revenue = orders.select(F.coalesce(F.round(F.sum("total"), 2), F.lit(0).cast("decimal(10,2)")))
    return films.agg(F.count(F.lit(1)).alias("total_films")).select(
        "total_films",
        _count(showings).alias("active_showings"),
        _count(theatres.where(F.col("status"))).alias("open_theatres"),
        revenue.scalar().alias("total_revenue"),
    )


def showing_schedule(showings: DataFrame, films: DataFrame) -> DataFrame:
    """Showings with film title by showing time (dashboard, overview, booking)."""
    s, f = showings.alias("s"), films.alias("f")
    return (s.join(f, F.col("s.film_id") == F.col("f.film_id"))
            .select("s.showing_id", "f.film_title", "s.film_theatre_number", "s.film_showing_datetime",
                    "s.film_available_seats")
            .orderBy(C.sort_seconds("film_showing_datetime").asc(), F.col("showing_id").asc()))


def recent_orders(orders: DataFrame, customers: DataFrame, tickets: DataFrame, limit: int = 12) -> DataFrame:
    """The newest orders with their ticket counts.

    Orders count only with a customer, but joining all of them for the newest few is
    waste: the newest ``limit`` are taken and looked up, then more of them as long as
    too few have a customer.  The rows found (``limit`` at most) are constants of the
    plan, and only their tickets are counted.
    """
    newest_first = [C.sort_seconds("created_at").desc_nulls_last(), F.col("order_number").desc()]
    n = limit
    while True:
        newest = orders.orderBy(*newest_first).limit(n)
        o, c = newest.alias("o"), customers.alias("c")
        named = (c.join(F.broadcast(o) if n <= MANY_ORDERS else o, F.col("c.customer_id") == F.col("o.order_customer_id"))
                 .select("o.order_number", C.full_name("c.firstname", "c.lastname").alias("customer_name"),
                         "o.total", "o.discount", "o.subtotal", "o.tax", "o.created_at"))
        found = named.orderBy(*newest_first).limit(limit).collect()  # at most ``limit`` rows
        if len(found) == limit or newest.count() < n:
            break
        n *= DEEPER
    top = orders.sparkSession.createDataFrame(found, named.schema)
    keys = F.broadcast(top.select(F.col("order_number").alias("ticket_order_number")))
    counts = (tickets.join(keys, "ticket_order_number", "left_semi")
              .groupBy("ticket_order_number").agg(F.count("ticket_id").alias("ticket_count")))
    return (top.join(F.broadcast(counts), top.order_number == counts.ticket_order_number, "left")
            .select(*[top[c] for c in top.columns],
                    F.coalesce(counts.ticket_count, F.lit(0)).alias("ticket_count"))
            .orderBy(*newest_first))


def customer_list(customers: DataFrame) -> DataFrame:
    """Overview customers."""
    return customers.select("customer_id", "firstname", "lastname", "email", "phone", "home_city",
                            "rewards_member", "pref_pymt_method").orderBy("customer_id")


def customer_directory(customers: DataFrame) -> DataFrame:
    """P7 (B1, B9, E8): directory with the membership flag shown as Yes/No."""
    return (customers.select("customer_id", "firstname", "lastname", "email",
                             C.yes_no("rewards_member").alias("rewards_member"))
            .orderBy("firstname", "lastname", "customer_id"))


def directory_count(customers: DataFrame) -> DataFrame:
    """Number of listed customers."""
    return customers.agg(F.count(F.lit(1)).alias("customer_count"))


def employee_list(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """C6, E6."""
    e, d = employees.alias("e"), departments.alias("d")
    return (e.join(d, F.col("d.department_id") == F.col("e.department_id"))
            .select("e.employee_id", "e.firstname", "e.lastname", "e.job_title", "e.status", "d.department_name")
            .orderBy("employee_id"))


def shift_board(shifts: DataFrame, employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Shifts with employee and (optional) department, newest first."""
    s, e, d = shifts.alias("s"), employees.alias("e"), departments.alias("d")
    return (s.join(e, F.col("e.employee_id") == F.col("s.employee_id"))
            .join(d, F.col("d.department_id") == F.col("s.shift_department_id"), "left")
            .select("s.shift_id", C.full_name("e.firstname", "e.lastname").alias("employee_name"),
                    "d.department_name", "s.showing_id", "s.shift_start_datetime", "s.shift_end_datetime")
            .orderBy(C.sort_seconds("shift_start_datetime").desc_nulls_last(), F.col("shift_id").desc()))


def film_list(films: DataFrame) -> DataFrame:
    return films.select("film_id", "film_title", "film_rating", "film_length_minutes", "film_language",
                        "film_last_showing_date").orderBy("film_id")


def theatre_list(theatres: DataFrame) -> DataFrame:
    return theatres.select("theatre_number", "theatre_seat_count", "accessible_seating", "status",
                           "status_notes").orderBy("theatre_number")


def concession_list(concessions: DataFrame) -> DataFrame:
    """By name (then key)."""
    return concessions.select("concession_id", "concession_name", "concession_size", "concession_type",
                              "concession_price").orderBy("concession_name", "concession_id")


def order_ledger(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """All orders with customer name, newest first."""
    o, c = orders.alias("o"), customers.alias("c")
    return (o.join(c, F.col("c.customer_id") == F.col("o.order_customer_id"))
            .select("o.order_number", C.full_name("c.firstname", "c.lastname").alias("customer_name"),
                    "o.subtotal", "o.tax", "o.discount", "o.total", "o.created_at")
            .orderBy(C.sort_seconds("created_at").desc_nulls_last(), F.col("order_number").desc()))


def ticket_detail(tickets: DataFrame, customers: DataFrame, showings: DataFrame, films: DataFrame) -> DataFrame:
    """C4, E5: every ticket with customer, film and showing time."""
    s, f = showings.alias("s"), films.alias("f")
    shows = (s.join(f, F.col("f.film_id") == F.col("s.film_id"))
             .select("s.showing_id", "f.film_title", "s.film_showing_datetime"))
    t, c = tickets.alias("t"), customers.alias("c")
    return (t.join(c, F.col("c.customer_id") == F.col("t.ticket_customer_id"))
            .join(shows.alias("sh"), F.col("sh.showing_id") == F.col("t.ticket_showing_id"))
            .select("t.ticket_id", "t.ticket_order_number",
                    C.full_name("c.firstname", "c.lastname").alias("customer_name"),
                    "sh.film_title", "sh.film_showing_datetime")
            .orderBy(F.col("ticket_id").desc()))


def top_films(tickets: DataFrame, showings: DataFrame, films: DataFrame) -> DataFrame:
    """Tickets per film; films without tickets are absent.

    Tickets are counted per showing first (partial aggregation happens before
    the shuffle), then per film, then the title is attached.
    """
    per_showing = tickets.groupBy("ticket_showing_id").agg(F.count("ticket_id").alias("n"))
    s = showings.select("showing_id", "film_id")
    per_film = (per_showing.join(s, per_showing.ticket_showing_id == s.showing_id)
                .groupBy("film_id").agg(F.sum("n").alias("tickets_sold")))
    f = films.select("film_id", "film_title")
    return (per_film.join(f, "film_id")
            .select("film_title", "tickets_sold", "film_id")
            .orderBy(F.col("tickets_sold").desc(), F.col("film_title"), F.col("film_id"))
            .drop("film_id"))


def concession_units(concessions: DataFrame, order_concessions: DataFrame) -> DataFrame:
    """Units sold per concession, 0 for unsold ones."""
    sold = order_concessions.groupBy("concession_id").agg(F.sum("quantity").alias("units"))
    c = concessions.select("concession_id", "concession_name", "concession_size")
    return (c.join(sold, "concession_id", "left")
            .select("concession_name", "concession_size",
                    F.coalesce(F.col("units"), F.lit(0)).cast("bigint").alias("units_sold"), "concession_id")
            .orderBy(F.col("units_sold").desc(), F.col("concession_name"), F.col("concession_id"))
            .drop("concession_id"))


def booking_customers(customers: DataFrame) -> DataFrame:
    """Customer picker."""
    return (customers.select("customer_id", C.full_name("firstname", "lastname").alias("full_name"),
                             "firstname", "lastname")
            .orderBy("firstname", "lastname", "customer_id").drop("firstname", "lastname"))


def booking_concessions(concessions: DataFrame) -> DataFrame:
    """Concession picker, by name then size."""
    return (concessions.select("concession_id", "concession_name", "concession_size", "concession_price")
            .orderBy("concession_name", "concession_size", "concession_id"))


def roster_by_department(employees: DataFrame, departments: DataFrame, supervisors: DataFrame) -> DataFrame:
    """P9 (C8, B10, E10): supervisor name or N/A."""
    e, d, s = employees.alias("e"), departments.alias("d"), supervisors.alias("s")
    return (e.join(d, F.col("e.department_id") == F.col("d.department_id"))
            .join(s, F.col("e.supervisor_id") == F.col("s.supervisor_id"), "left")
            .select(F.col("d.department_name").alias("Department"), F.col("e.employee_id").alias("EmployeeID"),
                    C.full_name("e.firstname", "e.lastname").alias("EmployeeName"),
                    F.col("e.job_title").alias("JobTitle"), F.col("e.status").alias("EmploymentStatus"),
                    F.coalesce(C.full_name("s.firstname", "s.lastname"), F.lit(C.NOT_AVAILABLE))
                    .alias("SupervisorName"),
                    F.col("e.lastname").alias("_lastname"))
            .orderBy("Department", "_lastname", "EmployeeID").drop("_lastname"))


def schedule_with_seats(showings: DataFrame, films: DataFrame, theatres: DataFrame) -> DataFrame:
    """P10 (C9, B9, B13): showings with theatre facts and seats sold."""
    sh, f, t = showings.alias("sh"), films.alias("f"), theatres.alias("t")
    return (sh.join(f, F.col("sh.film_id") == F.col("f.film_id"))
            .join(t, F.col("sh.film_theatre_number") == F.col("t.theatre_number"))
            .select(F.col("f.film_title").alias("FilmTitle"), F.col("f.film_rating").alias("Rating"),
                    F.col("f.film_length_minutes").alias("RuntimeMinutes"),
                    F.col("t.theatre_number").alias("TheatreNumber"),
                    F.col("t.theatre_seat_count").alias("TotalSeats"),
                    C.yes_no("t.accessible_seating").alias("AccessibleSeating"),
                    C.open_closed("t.status").alias("TheatreStatus"),
                    F.col("sh.film_showing_datetime").alias("ShowingDateTime"),
                    F.col("sh.film_available_seats").alias("AvailableSeats"),
                    (F.col("t.theatre_seat_count") - F.col("sh.film_available_seats")).alias("TicketsSold"),
                    F.col("sh.showing_id").alias("_showing_id"))
            .orderBy("ShowingDateTime", "_showing_id").drop("_showing_id"))


def order_summary(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """P11 (C1, B12, B10, E6): tax and total derived from subtotal and discount."""
    o = with_order_totals(orders).alias("o")
    c = customers.alias("c")
    return (o.join(c, F.col("o.order_customer_id") == F.col("c.customer_id"))
            .select(F.col("o.order_number").alias("OrderNumber"),
                    C.full_name("c.firstname", "c.lastname").alias("CustomerName"),
                    F.col("o.subtotal").alias("Subtotal"), F.col("o.tax").alias("Tax"),
                    F.coalesce(F.col("o.discount"), F.lit(0).cast("decimal(10,2)")).alias("Discount"),
                    F.col("o.total").alias("OrderTotal"))
            .orderBy("OrderNumber"))


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """P12 (D9, F1): one count per table, stacked by UNION ALL."""
    parts = [df.agg(F.count(F.lit(1)).alias("TotalRows")).select(F.lit(name).alias("TableName"), "TotalRows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _js_number(c):
    """Money as a script prints a JSON number: 5.00 -> 5, 7.50 -> 7.5."""
    return F.regexp_replace(F.regexp_replace(F.col(c).cast("decimal(10,2)").cast("string"), "0$", ""), r"\.0?$", "")


def booking_options(customers: DataFrame, showings: DataFrame, films: DataFrame,
                    concessions: DataFrame) -> DataFrame:
    """The booking form's option labels, (list_name, value, label) for each picker:
    ``<full name> (<id>)``, ``<title> | Theatre <n> | <time>`` and
    ``<name> (<size or —>) — $<price>``.  The lists have no order here; the pickers' own result sets do."""
    c = customers.select(F.lit("customers").alias("list_name"), F.col("customer_id").cast("string").alias("value"),
                         C.label(C.full_name("firstname", "lastname"), " (", F.col("customer_id").cast("string"), ")").alias("label"))
    s, f = showings.alias("s"), films.alias("f")
    s = s.join(f, F.col("s.film_id") == F.col("f.film_id")).select(
        F.lit("showings").alias("list_name"), F.col("s.showing_id").cast("string").alias("value"),
        C.label(F.col("f.film_title"), " | Theatre ", F.col("s.film_theatre_number").cast("string"), " | ",
                F.date_format("s.film_showing_datetime", C.DISPLAY_PATTERN)).alias("label"))
    i = concessions.select(F.lit("concessions").alias("list_name"), F.col("concession_id").cast("string").alias("value"),
                           C.label(F.col("concession_name"), " (", C.or_dash("concession_size"), ") — $",
                                   _js_number("concession_price")).alias("label"))
    return c.unionByName(s).unionByName(i)
