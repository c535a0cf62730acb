"""Explicit schemas of the engine inputs and of the serving tables."""

from __future__ import annotations

SALES = "Producto string, SUCURSAL string, TipoVenta string, Fecha date, CantidadAjustada long, Fuente string"
MAPPING = "Producto string, Producto_Master string"
DIM_PRODUCT = "Producto string, Categoria string"
DIM_BRANCH = (
    "SucursalID string, Nombre string, Region string, Tipo string, EsOperativa boolean, "
    "CodigoLocal string"
)
TRACKING = (
    "Producto string, SucursalID string, RazonSocial string, FechaOC date, NOC long, "
    "Origen string, Motivo string"
)
TRACKING_TRANSIT = TRACKING + ", Cantidad long, EstadoOC string, EstadoDoc string, FechaDoc date"
TRACKING_LEAD_TIME = (
    "RazonSocial string, SucursalID string, FechaOC date, FechaPE date, Origen string, "
    "Motivo string"
)
LEAD_TIME_SUPPLIER = "`Lead Time Dias` double, `Razon Social Proveedor` string"
LEAD_TIME_SUPPLIER_BRANCH = (
    "`Lead Time Dias` double, `N Muestras` long, `Razon Social Proveedor` string, "
    "SucursalID string"
)
IMPORTED = "Producto string"
STOCK = "Producto string, SucursalID string, Stock long"
CATALOGUE = "Producto string, Descripcion string, FILTRO1_Final string, UnidadMedida string"
COST = "Producto string, Costo string"

MONTHLY_SALES = "producto string, sucursal_id string, mes string, cantidad double"
STOCK_UNIFIED = (
    "producto string, bodega string, sucursal_id string, stock double, origen string"
)
MANUAL = (
    "id string, producto string, sucursal_id string, unidades long, motivo string, "
    "creado_por string, creado_en timestamp, archivada boolean, recurrente_id string, "
    "lote_id string, expira_en timestamp"
)
RECURRING = (
    "id string, modo string, producto string, sucursal_id string, filtros string, "
    "unidades long, dias_inventario int, motivo string, cada_dias int, "
    "proxima_ejecucion date, fecha_fin date, activa boolean, ultima_ejecucion date"
)
FILTERS = (
    "q string, sucursales array<string>, abc array<string>, filtro1 array<string>, "
    "tipo_origen array<string>, proveedores array<string>, proveedor string, "
    "solo_pedir boolean, solo_nacionales boolean, vista string"
)

# Columns of the contract that hold no text, by type; its stock columns are whole numbers.
CONTRACT_TYPES = {
    "long": (
        "Meses con Venta 3m", "Meses con Venta 6m", "Meses con Venta 12m", "Stock de Seguridad",
        "stock_activo_suc", "stock_en_transito_suc", "stock_en_cd",
    ),
    "int": ("LT CD a Sucursal Dias", "Prioridad CD"),
    "double": (
        "Lead Time Dias", "LT Efectivo", "Demanda Mensual", "Desv Std Mensual", "Demanda Diaria", "Costo Unitario",
        "Punto de Pedido", "total_sugerido_suc", "total_valor_sugerido_clp", "sugerido_suc", "sugerido_traslado", "sugerido_compra_neto",
    ),
    "boolean": ("Es Importado", "Tiene Stock CD"),
}
