"""Synthetic transactions of any volume.

One projection over any DataFrame that has an id column: ``spark.range``, a rate
stream, or a stored table. No shuffle, no Python, same rows on every run.
"""

from __future__ import annotations

import configparser
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import draws
from tidemark.functions.columns import named
from tidemark.schema import TRANSACTION_COLUMNS

# The property names, and the values they have by default.
_LENGTHS = {
    "transactionIdLength": 9,
    "cardNumberLength": 18,
    "merchantKeyLength": 4,
    "mccDescLength": 4,
}
_AMOUNTS = {
    "baseTransactionAmount": 10.0,
    "limitTransactionAmount": 150.0,
    "baseChargebackAmount": 0.0,
    "limitChargebackAmount": 50.0,
}
_TIMES = {
    "eventStartTimestamp": "2017-08-01 00:00:00",
    "eventEndTimestamp": "2017-08-31 00:00:00",
}
_LISTS = {
    "processingFlagList": "approved,declined",
    "cardTypeList": "credit,debit",
    "categoryNameList": "leisure,public_sector,prof_services,retail,transport",
    "cityList": "London,Manchester,Cardiff",
    "chargebackCategoryList": (
        "cancelled,fraud,non_receipt_goods,processing_error,request_for_info,NA"
    ),
    "chargebackResolutionList": "charged_back,open,represented,NA",
}
_ZIP_PREFIX = "zipcode."
_ZIPS = {
    "London": "WC1V,EC1R,EC1M,EC2A,EC4Y",
    "Manchester": "M45,M61,M30,M23",
    "Cardiff": "CF15,CF14",
}


# One digest per row and subject; each serves up to four columns.
_SUBJECTS = ("transaction", "card", "merchant", "charge")
_DIGEST_PREFIX = "_digest_"
# Columns of digits: their length's property, and the halves their draws come from.
_DIGIT_COLUMNS = {
    "unique_transact_id": ("transactionIdLength", [("transaction", 0)]),
    "card_num": ("cardNumberLength", [("card", 0), ("card", 1)]),
    "merchant_key": ("merchantKeyLength", [("merchant", 0)]),
    "mcc_desc": ("mccDescLength", [("merchant", 1)]),
}


def _half_name(subject: str, half: int) -> str:
    return f"_half_{subject}_{half}"


def _digit_halves(column: str, length: int) -> list[tuple[str, int]]:
    """The halves for so many digits; beyond the column's own ones from further digests."""
    own = _DIGIT_COLUMNS[column][1]
    needed = -(-length // draws.DIGITS_PER_DRAW)
    further = [(f"{column}_{i // 2}", i % 2) for i in range(needed - len(own))]
    return (own + further)[:needed]


def _items(text: str) -> tuple[str, ...]:
    """A list property's items, by the same rules as ``split_list`` (P10)."""
    kept = text.rstrip(",")
    return tuple(kept.split(",")) if kept or not text else ()


def read_properties(text: str) -> dict[str, str]:
    """``name=value`` lines with ``#`` comments; of a repeated name the last value counts."""
    parser = configparser.ConfigParser(
        delimiters=("=",), comment_prefixes=("#",), interpolation=None, strict=False
    )
    parser.optionxform = str
    parser.read_string("[properties]\n" + text)
    return dict(parser["properties"])


@dataclass(frozen=True)
class SynthConfig:
    """Lengths, ranges and value lists of the generator."""

    lengths: Mapping[str, int] = field(default_factory=lambda: dict(_LENGTHS))
    amounts: Mapping[str, float] = field(default_factory=lambda: dict(_AMOUNTS))
    times: Mapping[str, str] = field(default_factory=lambda: dict(_TIMES))
    lists: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {name: _items(text) for name, text in _LISTS.items()}
    )
    zips: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {city: _items(text) for city, text in _ZIPS.items()}
    )

    @classmethod
    def from_properties(cls, text: str) -> SynthConfig:
        """The settings in a properties text; what is not given keeps its default."""
        given = read_properties(text)
        lists = {name: _items(given.get(name, text)) for name, text in _LISTS.items()}
        zips = {}
        for city in lists["cityList"]:
            listed = given.get(_ZIP_PREFIX + city, _ZIPS.get(city))
            if listed is None:
                raise ValueError(f"no {_ZIP_PREFIX}{city} list for city {city!r}")
            zips[city] = _items(listed)
        return cls(
            lengths={name: int(given.get(name, value)) for name, value in _LENGTHS.items()},
            amounts={name: float(given.get(name, value)) for name, value in _AMOUNTS.items()},
            times={name: given.get(name, value) for name, value in _TIMES.items()},
            lists=lists,
            zips=zips,
        )

    def millis(self, name: str) -> int:
        """A configured time as epoch milliseconds, read as UTC."""
        moment = datetime.fromisoformat(self.times[name]).replace(tzinfo=timezone.utc)
        return int(moment.timestamp()) * 1000


def synth_transactions(
    ids: DataFrame,
    id_col: str = "id",
    config: SynthConfig | None = None,
    seed: int = 42,
    time_col: str | None = None,
    independent_zip: bool = False,
    given: Mapping[str, Column] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The 14 transaction columns, one row for each row of ``ids``.

    ``time_col`` names a timestamp to take ``trans_time`` from, as a rate stream
    has; without it the time is drawn from the configured range. The zip belongs
    to the row's own city unless ``independent_zip`` asks for a second city draw.
    ``given`` replaces the draw of single columns by expressions over ``ids``, and
    ``keep`` names columns of ``ids`` to carry along in front.

    Ids of nine random digits repeat after some ten thousand rows, so do not
    deduplicate generated rows on ``unique_transact_id``.
    """
    config = config or SynthConfig()
    given = dict(given or {})
    unknown = set(given) - set(TRANSACTION_COLUMNS)
    if unknown:
        raise ValueError(f"not transaction columns: {sorted(unknown)}")

    def wide(subject: str, half: int) -> Column:
        return draws.wide(named(_half_name(subject, half)))

    def narrow(subject: str, half: int) -> Column:
        return draws.narrow(named(_half_name(subject, half)))

    digit_halves = {
        column: _digit_halves(column, config.lengths[length])
        for column, (length, _) in _DIGIT_COLUMNS.items()
    }

    def digits(column: str) -> Column:
        numbers = [wide(subject, half) for subject, half in digit_halves[column]]
        return draws.digits(numbers, config.lengths[_DIGIT_COLUMNS[column][0]])

    def amount(drawn: Column, base: str, limit: str) -> Column:
        return draws.uniform(drawn, config.amounts[base], config.amounts[limit]).cast("string")

    def pick(drawn: Column, values: str) -> Column:
        return draws.pick(drawn, config.lists[values])

    if time_col is None:
        start, end = config.millis("eventStartTimestamp"), config.millis("eventEndTimestamp")
        if not start < end:
            raise ValueError(f"no times between {config.times}")
        time = (F.lit(start) + wide("charge", 1) % F.lit(end - start)).cast("string")
    else:
        time = draws.epoch_millis(named(time_col))

    city = given.get("city", pick(narrow("merchant", 0), "cityList"))
    zip_city = pick(narrow("card", 1), "cityList") if independent_zip else city
    columns = {
        "unique_transact_id": digits("unique_transact_id"),
        "card_num": digits("card_num"),
        "processing_flag": pick(narrow("transaction", 0), "processingFlagList"),
        "trans_amt": amount(
            wide("transaction", 1), "baseTransactionAmount", "limitTransactionAmount"
        ),
        "trans_time": time,
        "card_type": pick(narrow("card", 0), "cardTypeList"),
        "merchant_key": digits("merchant_key"),
        "mcc_desc": digits("mcc_desc"),
        "category_name": pick(narrow("transaction", 1), "categoryNameList"),
        "city": city,
        "zip": draws.pick_for(narrow("merchant", 1), zip_city, config.zips),
        "chrgbck_amt": amount(wide("charge", 0), "baseChargebackAmount", "limitChargebackAmount"),
        "chargeback_cat": pick(narrow("charge", 0), "chargebackCategoryList"),
        "chargeback_res": pick(narrow("charge", 1), "chargebackResolutionList"),
        **given,
    }
    used = dict.fromkeys([(subject, half) for subject in _SUBJECTS for half in (0, 1)])
    used.update(dict.fromkeys(pair for pairs in digit_halves.values() for pair in pairs))
    digests = {
        _DIGEST_PREFIX + subject: draws.digest(seed, named(id_col), subject)
        for subject, _ in used
    }
    halves = {
        _half_name(subject, half): draws.half(named(_DIGEST_PREFIX + subject), half)
        for subject, half in used
    }
    drawn = ids.withColumns(digests).withColumns(halves)
    return drawn.select(
        *[named(c) for c in keep], *[columns[c].alias(c) for c in TRANSACTION_COLUMNS]
    )
