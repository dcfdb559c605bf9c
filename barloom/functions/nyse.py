"""Exchange holiday rules as column expressions on a date.

Monday-type holidays are recognised by weekday and day of month: the third Monday of a month is the
Monday that falls on the 15th to 21st, and so on. The rules cover 1970 to 2200.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def easter_sunday(day: str) -> Column:
    """Easter of the year of `day` by the Gregorian computus (integer arithmetic on golden number, century and epact)."""
    y = f"year({day})"
    golden, century, rest = f"({y} % 19)", f"({y} div 100)", f"({y} % 100)"
    skipped = f"(({century} - ({century} + 8) div 25 + 1) div 3)"
    epact = f"((19 * {golden} + {century} - {century} div 4 - {skipped} + 15) % 30)"
    to_sunday = f"((32 + 2 * ({century} % 4) + 2 * ({rest} div 4) - {epact} - {rest} % 4) % 7)"
    late = f"(({golden} + 11 * {epact} + 22 * {to_sunday}) div 451)"
    after_march_22 = f"({epact} + {to_sunday} - 7 * {late})"
    return F.date_add(F.expr(f"make_date({y}, 3, 22)"), F.expr(f"CAST({after_march_22} AS INT)"))


def is_trading_day(day: str) -> Column:
    """True on exchange days: no weekend and none of the ten holidays."""
    d = F.col(day)
    year, month, dom, dow = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)
    monday, thursday, friday = dow == 0, dow == 3, dow == 4

    def nearest_workday(m: int, on: int) -> Column:
        return (month == m) & ((dom == on) | ((dom == on - 1) & friday) | ((dom == on + 1) & monday))

    holiday = (
        ((month == 1) & ((dom == 1) | ((dom == 2) & monday)))               # New Year: Sunday moves, Saturday does not
        | ((month == 1) & monday & dom.between(15, 21) & (year >= 1986))    # King
        | ((month == 2) & monday & dom.between(15, 21))                     # Presidents
        | (d == F.date_sub(easter_sunday(day), 2))                          # Good Friday
        | ((month == 5) & monday & dom.between(25, 31))                     # Memorial
        | (nearest_workday(6, 19) & (year >= 2022))                         # Juneteenth
        | nearest_workday(7, 4)                                             # Independence
        | ((month == 9) & monday & dom.between(1, 7))                       # Labor
        | ((month == 11) & thursday & dom.between(22, 28))                  # Thanksgiving
        | nearest_workday(12, 25)                                           # Christmas
    )
    return (dow < 5) & ~(holiday & year.between(1970, 2200))
