"""Page readers by shop platform; all of them build Column expressions over a parsed page."""

from shelfwright.operators.adapters.base import Adapter
from shelfwright.operators.adapters.generic import GenericAdapter
from shelfwright.operators.adapters.mcas import McasAdapter
from shelfwright.operators.adapters.shopify import ShopifyAdapter

ADAPTERS: dict[str, type[Adapter]] = {
    "shopify": ShopifyAdapter,
    "mcas": McasAdapter,
    "generic": GenericAdapter,
}


def adapter_class(adapter_type: str) -> type[Adapter]:
    """The reader of a platform; an unknown platform is read generically."""
    return ADAPTERS.get(adapter_type, GenericAdapter)


__all__ = ["ADAPTERS", "Adapter", "adapter_class"]
