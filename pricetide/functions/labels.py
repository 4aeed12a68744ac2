"""Texts that readers see and keys that caches use, as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.scalars import digits, half_up, is_public_host

# Signs of currencies in English text, and currencies without a minor unit.
SIGNS = {
    "EUR": "€", "USD": "$", "GBP": "£", "JPY": "¥", "INR": "₹", "CNY": "CN¥", "KRW": "₩", "AUD": "A$", "CAD": "CA$", "NZD": "NZ$",
    "MXN": "MX$", "BRL": "R$", "ILS": "₪", "VND": "₫", "TWD": "NT$", "HKD": "HK$", "PHP": "₱",
}
WHOLE = ("JPY", "KRW", "VND", "CLP", "ISK", "PYG", "UGX", "XAF", "XOF")
# What readers see of a status or a reason.
STATUSES = {"not_found": "Not found", "needs_review": "Needs review", "unavailable": "Unavailable"}
REASONS = {
    "captcha": "CAPTCHA", "bot_wall": "Bot wall", "login_wall": "Login required", "js_challenge": "JavaScript challenge", "wrong_product": "Wrong product", "low_confidence": "Low confidence",
    "price_missing": "Price missing", "profile_drift": "Profile drift", "timeout": "Timed out", "robots_disallowed": "Blocked by policy", "rate_limited": "Rate limited", "request_queue_busy": "Scan queue busy",
}
ZONE = "Europe/Ljubljana"
#: Longest wait that a store's header may ask for.
LONGEST_WAIT_MS = 6 * 3_600_000


def _mapped(value: Column, names: dict[str, str], other: Column) -> Column:
    out = other
    for key, name in names.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def money_text(cents: Column, currency: Column) -> Column:
    """An amount as English text: the currency's sign or its code before the number, thousands apart; a code of other than three letters comes last."""
    code, amount = F.upper(currency), F.abs(cents) / 100
    number = F.when(code.isin(*WHOLE), F.format_number(half_up(amount), 0)).otherwise(F.format_number(amount, 2))
    text = F.concat(F.when(cents < 0, "-").otherwise(""), _mapped(code, SIGNS, F.concat(code, F.lit(" "))), number)
    return F.when(code.rlike("^[A-Z]{3}$"), text).otherwise(F.concat(F.format_string("%.2f", cents / 100), F.lit(" "), currency))


def local_time(at: Column, zone: str = ZONE) -> Column:
    """Day first, in the application's zone; `at` is a timestamp without a zone that holds UTC."""
    text = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")), "d MMM yyyy, HH:mm")
    return F.replace(text, F.lit(" Sep "), F.lit(" Sept "))


def _clamped(ms: Column) -> Column:
    return F.when(ms.isNotNull(), F.greatest(F.lit(0), F.least(ms.cast("long"), F.lit(LONGEST_WAIT_MS))))


def _until(at: Column, now: Column) -> Column:
    return F.unix_millis(at.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))


def retry_after_ms(header: Column, now: Column) -> Column:
    """The wait that a retry-after header asks for, in seconds or as an HTTP date, at most six hours; null for junk."""
    seconds = F.when(F.trim(header).rlike(r"^\d+(\.\d*)?$"), F.trim(header).try_cast("double") * 1000)
    date = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return _clamped(F.coalesce(seconds, _until(date, now)))


def rate_limit_reset_ms(header: Column, now: Column) -> Column:
    """The wait until a rate limit's reset, given in seconds, epoch seconds or epoch milliseconds, at most six hours."""
    value, at = F.when(F.trim(header).rlike(r"^\d+(\.\d*)?$"), F.trim(header).try_cast("double")), F.unix_millis(now.cast("timestamp"))
    return _clamped(F.when(value > 1e10, value - at).when(value > 1e9, value * 1000 - at).otherwise(value * 1000))


def sitemap_key(host: Column, ean: Column) -> Column:
    """A JSON pair of a public host, without www. and a final dot, and a code's digits; null for hosts that aren't public."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.$", "")
    return F.when(is_public_host(plain), F.to_json(F.array(plain, digits(ean))))


def percent_text(share: Column) -> Column:
    """A share in per cent with one decimal, and none where that is 0."""
    tenths = half_up(share * 1000).cast("long")
    size = F.abs(tenths)
    whole, rest = F.floor(size / 10).cast("string"), (size % 10).cast("string")
    return F.concat(F.when(tenths < 0, "-").otherwise(""), whole, F.when(rest == "0", "").otherwise(F.concat(F.lit("."), rest)), F.lit("%"))


def status_label(status: Column) -> Column:
    return _mapped(status, STATUSES, F.replace(status, F.lit("_"), F.lit(" ")))


def reason_label(reason: Column) -> Column:
    return _mapped(reason, REASONS, status_label(reason))


def country_codes(spark: SparkSession) -> list[str]:
    """Two-letter codes of countries as the platform's library lists them (ISO 3166-1)."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def country_code(name: Column, codes: Sequence[str]) -> Column:
    """A two-letter code in capitals, UK as GB; null for anything that isn't among `codes`."""
    code = F.upper(F.trim(name))
    return F.when(code == "UK", "GB").when(code.isin(*codes), code)


#: Letters with one mark or more, and the plain letters beneath them.
_MARKED = {c: d[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}


def without_marks(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), "[̀-ͯ]", "")


def norm_header(text: Column) -> Column:
    """A sheet's heading in small letters, without marks, and with punctuation as single spaces."""
    return F.trim(F.regexp_replace(without_marks(F.lower(F.trim(F.coalesce(text, F.lit(""))))), r"[/_()\-\s]+", " "))
