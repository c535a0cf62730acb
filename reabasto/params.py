"""Business parameters. Every operator takes its constants from here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from reabasto import fixed_values as V


@dataclass(frozen=True)
class Params:
    # branches
    cd_id: str = V.CD_ID
    excluded_branches: tuple[str, ...] = V.EXCLUDED_BRANCHES
    cd_special_branches: tuple[str, ...] = V.CD_SPECIAL_BRANCHES
    branch_merges: Mapping[str, str] = field(default_factory=lambda: dict(V.BRANCH_MERGES))
    mobile_branch: str = V.MOBILE_BRANCH
    mobile_sale_type: str = V.MOBILE_SALE_TYPE
    mobile_branch_final: str = V.MOBILE_BRANCH_FINAL
    operating_branches: tuple[str, ...] = V.OPERATING_BRANCHES
    stock_columns: Mapping[str, str] = field(default_factory=lambda: dict(V.STOCK_COLUMN_BRANCHES))
    branch_name_fallback: Mapping[str, str] = field(
        default_factory=lambda: dict(V.BRANCH_NAME_FALLBACK)
    )
    unknown_branch: str = V.UNKNOWN_BRANCH
    # products
    excluded_products: tuple[str, ...] = V.EXCLUDED_PRODUCTS
    excluded_categories: tuple[str, ...] = V.EXCLUDED_CATEGORIES
    rubro_family: Mapping[int, str] = field(default_factory=lambda: dict(V.RUBRO_FAMILY))
    hidden_prefixes: tuple[str, ...] = V.HIDDEN_PREFIXES
    # documents and companies
    credit_note_types: tuple[str, ...] = V.CREDIT_NOTE_TYPES
    part_product_types: tuple[str, ...] = V.PART_PRODUCT_TYPES
    border_documents: tuple[str, ...] = V.BORDER_DOCUMENTS
    border_product_type: str = "REPUESTO"
    border_issued: str = "Emitido"
    border_branch_prefixes: Mapping[str, str] = field(
        default_factory=lambda: dict(V.BORDER_BRANCH_PREFIXES)
    )
    source_main: str = V.SOURCE_MAIN
    source_border: str = V.SOURCE_BORDER
    # purchase tracking
    origin_national: str = V.ORIGIN_NATIONAL
    origin_imported: str = V.ORIGIN_IMPORTED
    origin_border: str = V.ORIGIN_BORDER
    reason_replenish: str = "reposicion"
    state_pending: str = "pendiente"
    tracking_map_national: Mapping[str, str] = field(
        default_factory=lambda: dict(V.TRACKING_BRANCH_NATIONAL)
    )
    tracking_map_imported: Mapping[str, str] = field(
        default_factory=lambda: dict(V.TRACKING_BRANCH_IMPORTED)
    )
    tracking_map_border: Mapping[str, str] = field(
        default_factory=lambda: dict(V.TRACKING_BRANCH_BORDER)
    )
    warehouse_map: Mapping[str, str] = field(default_factory=lambda: dict(V.WAREHOUSE_BRANCH))
    # sale frequency classes
    closed_months_only: bool = False
    window_short: int = 3
    window_mid: int = 6
    window_long: int = 12
    months_a: int = 5
    months_b: int = 4
    months_c: int = 3
    recent_months_c: int = 2
    long_months_c: int = 6
    # demand
    winsor_k: float = 3.0
    mad_scale: float = 1.4826
    working_days: int = 22
    # order cycle, lead time
    cycle_days: int = 5
    cycle_days_cd: int = 3
    lead_time_fallback: int = 8
    lead_time_cap: int = 30
    cut_national: float = 0.7
    cut_other: float = 0.8
    cd_days_home_region: int = 1
    cd_days_other: int = 2
    home_region: str = "RM"
    cd_days_special: Mapping[str, int] = field(
        default_factory=lambda: dict(V.CD_TRANSIT_SPECIAL_DAYS)
    )
    transit_days_national: int = 30
    transit_days_imported: int = 180
    transit_days_border: int = 30
    # safety stock
    z_by_class: Mapping[str, float] = field(default_factory=lambda: dict(V.Z_BY_CLASS))
    z_imported_via_cd: Mapping[str, float] = field(
        default_factory=lambda: dict(V.Z_IMPORTED_VIA_CD)
    )
    # centralisation
    buying_classes: tuple[str, ...] = ("A", "B")
    tail_classes: tuple[str, ...] = ("C", "D")
    cd_priority: Mapping[str, int] = field(default_factory=lambda: dict(V.CD_PRIORITY))
    cd_priority_default: int = 99
    # publishing
    min_rows_ratio: float = 0.7
    anomaly_units: float = 10_000
    business_zone: str = "America/Santiago"
    max_expiry_year: int = 2100
    no_supplier_label: str = "Sin proveedor asignado"
    no_branch_label: str = "(sin sucursal)"
    blank_label: str = "(en blanco)"
