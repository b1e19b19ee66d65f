"""The canonical bundle: eleven tables from one raw bundle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame

from riskloom.operators import canonical, enrich
from riskloom.session import materialise
from riskloom.settings import Enrichment

# stage boundaries: what other tables are derived from
STORED = (
    "accounts",
    "alerts",
    "transactions",
    "account_device_links",
    "account_ip_links",
    "transaction_merchant_links",
)


class LazyTables(Mapping[str, DataFrame]):
    """Tables by name, each built when it is first asked for and kept: a job pays for the tables that it reads."""

    def __init__(self, names: Sequence[str], build: Callable[[str], DataFrame]):
        self._names, self._build, self._built = tuple(names), build, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def __or__(self, other: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {**self, **other}


def canonical_tables(
    raw: dict[str, DataFrame], layout_name: str, enrichment: Enrichment = Enrichment()
) -> LazyTables:
    """The eleven tables. Those that others are derived from are written once to the shared folder; the others are
    plans over them, so that no table rebuilds another. A table is built, with those it is derived from, when it is
    first asked for."""
    builders = {
        "accounts": lambda t: canonical.canonical_accounts(raw["accounts"], raw["alerts"], layout_name),
        "parties": lambda t: canonical.canonical_parties(t["accounts"], t["alerts"]),
        "transactions": lambda t: canonical.canonical_transactions(raw, t["accounts"], t["alerts"], layout_name),
        "alerts": lambda t: canonical.canonical_alerts(raw["alerts"], t["accounts"], layout_name),
        "banks": lambda t: canonical.canonical_banks(t["accounts"]),
        "devices": lambda t: enrich.devices(t["account_device_links"]),
        "ip_addresses": lambda t: enrich.addresses(t["account_ip_links"]),
        "merchants": lambda t: enrich.merchants(t["transaction_merchant_links"]),
        "account_device_links": lambda t: enrich.device_links(t["accounts"], enrichment),
        "account_ip_links": lambda t: enrich.address_links(t["accounts"], enrichment),
        "transaction_merchant_links": lambda t: enrich.merchant_links(t["transactions"], enrichment),
    }

    def build(name: str) -> DataFrame:
        rows = builders[name](tables)
        return materialise(rows, name) if name in STORED else rows

    tables = LazyTables(tuple(builders), build)
    return tables
