"""Fixed values.

Every literal the business rules depend on: branch and document names, lookup
tables, header aliases, numeric constants. They are stated plainly here and only
here; operators receive them through `Params`.
"""


# Distribution centre and branch clean-up
CD_ID = "CD REPUESTOS"
EXCLUDED_BRANCHES = (
    "COQUIMBO",
    "GRAN AVENIDA",
    "LA FLORIDA",
    "LIRA",
    "LO BLANCO",
    "MALL PLAZA NORTE",
    "MALL PLAZA SUR",
    "MALL PLAZA VESPUCIO",
    "OVALLE (3)",
)
CD_SPECIAL_BRANCHES = (
    "CANAL DIGITAL",
    "LINDEROS VTA MOVIL",
    "OFICINAS CENTRALES",
)
BRANCH_MERGES = {
    "RANCAGUA 2": "RANCAGUA",
}
MOBILE_BRANCH = "LINDEROS"
MOBILE_SALE_TYPE = "VTA MOVIL"
MOBILE_BRANCH_FINAL = "LINDEROS VTA MOVIL"
EXCLUDED_PRODUCTS = (
    "13 BH1X70005AA",
    "APLICA-DED-REPTO",
    "D&P REPTO-TALLER(R)",
    "D&P REPTO-TALLER(T)",
    "INCENTIVOS RPTOS",
    "MEC INSUMOS-PESADOS",
)
EXCLUDED_CATEGORIES = (
    "CAMPAÃ‘AS",
    "CAMPAÑAS",
    "COLISION",
)

# CD priority (1 is served first) and operating branches in display order
CD_PRIORITY = {
    "DIEZ DE JULIO (2)": 1,
    "BRASIL 18": 2,
    "LINDEROS": 3,
    "PLACILLA": 4,
    "RANCAGUA": 5,
    "RANCAGUA 2": 6,
    "CURICO": 7,
    "TALCA": 8,
    "TALCA (2)": 9,
    "CHILLAN": 10,
    "CHILLAN VIEJO": 11,
}
OPERATING_BRANCHES = (
    "LINDEROS",
    "CURICO",
    "TALCA",
    "RANCAGUA",
    "DIEZ DE JULIO (2)",
    "CHILLAN",
    "BRASIL 18",
    "PLACILLA",
    "CHILLAN VIEJO",
    "TALCA (2)",
)
STOCK_COLUMN_BRANCHES = {
    "LINDEROS": "stock_linderos",
    "CURICO": "stock_curico",
    "TALCA": "stock_talca",
    "RANCAGUA": "stock_rancagua",
    "DIEZ DE JULIO (2)": "stock_diez_de_julio_2",
    "CHILLAN": "stock_chillan",
    "CD REPUESTOS": "stock_cd_repuestos",
    "BRASIL 18": "stock_brasil_18",
    "PLACILLA": "stock_placilla",
    "CHILLAN VIEJO": "stock_chillan_viejo",
    "TALCA (2)": "stock_talca_2",
}
CD_TRANSIT_SPECIAL_DAYS = {
    "TALCA (2)": 2,
    "DIEZ DE JULIO (2)": 1,
    "LINDEROS VTA MOVIL": 1,
}

# Service factors per class
Z_BY_CLASS = {
    "A": 1.645,
    "B": 1.282,
    "C": 0.842,
    "D": 0.0,
}
Z_IMPORTED_VIA_CD = {
    "A": 1.282,
    "B": 1.036,
}

# Document types, product types and company tags
CREDIT_NOTE_TYPES = (
    "NC CLIENTE S/T",
    "NC LIQ FACT",
    "NC SEGURO S/T",
    "NC-ELECTR GD_FAC",
    "NC-ELECTR REPTO",
)
PART_PRODUCT_TYPES = (
    "REPUESTO",
    "REPUESTOS",
)
BORDER_DOCUMENTS = (
    "CARGO INTERNO",
    "FACTURA ST",
    "NOTA CREDITO ST",
    "REFACTURACION C/RS",
    "REFACTURACION ST",
)
BORDER_BRANCH_PREFIXES = {
    "02 LINDEROS": "LINDEROS",
    "03 PLACILLA": "PLACILLA",
    "05 RANCAGUA": "RANCAGUA",
    "07 CURICO": "CURICO",
    "10 CHILLAN VIEJO": "CHILLAN VIEJO",
}
ORIGIN_NATIONAL = "Curifor Nacional"
ORIGIN_IMPORTED = "Curifor Importado"
ORIGIN_BORDER = "Frontera Nacional"
SOURCE_MAIN = "Curifor"
SOURCE_BORDER = "Frontera"

# Purchase tracking, branch code to branch
TRACKING_BRANCH_NATIONAL = {
    "SUC020": "CHILLAN",
    "SUC030": "CHILLAN VIEJO",
    "SUC040": "COQUIMBO",
    "SUC050": "CURICO",
    "SUC070": "LINDEROS",
    "SUC080": "LIRA",
    "SUC110": "LO BLANCO",
    "SUC120": "PLACILLA",
    "SUC130": "RANCAGUA",
    "SUC140": "SAN FERNANDO",
    "SUC150": "TALCA",
    "SUC160": "TALCA (2)",
    "SUC230": "MALL PLAZA NORTE",
    "SUC240": "DIEZ DE JULIO (2)",
    "SUC250": "BRASIL 18",
    "SUC260": "CONCEPCION",
    "SUC270": "GRAN AVENIDA",
    "SUC280": "CD REPUESTOS",
    "SUC310": "RANCAGUA",
    "SUC360": "OFICINAS CENTRALES",
}
TRACKING_BRANCH_IMPORTED = {
    "SUC020": "CHILLAN",
    "SUC030": "CHILLAN VIEJO",
    "SUC040": "COQUIMBO",
    "SUC050": "CURICO",
    "SUC070": "LINDEROS",
    "SUC080": "LIRA",
    "SUC110": "LO BLANCO",
    "SUC120": "PLACILLA",
    "SUC130": "RANCAGUA",
    "SUC140": "SAN FERNANDO",
    "SUC150": "TALCA",
    "SUC160": "TALCA 2",
    "SUC230": "MALL PLAZA NORTE",
    "SUC240": "DIEZ DE JULIO",
    "SUC250": "BRASIL 18",
    "SUC260": "CONCEPCION",
    "SUC270": "GRAN AVENIDA",
    "SUC280": "CD REPUESTOS",
    "SUC310": "RANCAGUA 2",
    "SUC360": "OFICINAS CENTRALES",
}
TRACKING_BRANCH_BORDER = {
    "BRASIL 18": "BRASIL 18",
    "CD REPUESTOS": "CD REPUESTOS",
    "CHILLAN VIEJO": "CHILLAN VIEJO",
    "CURICO": "CURICO",
    "DIEZ DE JULIO (2)": "DIEZ DE JULIO (2)",
    "LINDEROS": "LINDEROS",
    "PLACILLA": "PLACILLA",
    "RANCAGUA": "RANCAGUA",
}
UNKNOWN_BRANCH = "DESCONOCIDO"

# Report columns, field to header text
REPORT_TRACKING_NATIONAL = {
    "Producto": "Producto",
    "Sucursal": "Sucursal",
    "RazonSocial": "Razón Social Proveedor",
    "Motivo": "Motivo Compra",
    "FechaOC": "Fecha Orden de Compra",
    "NOC": "N° Orden de Compra",
    "Cantidad": "Cantidad",
    "EstadoOC": "Estado Orden de Compra",
    "EstadoDoc": "Estado Documento Base",
    "FechaDoc": "Fecha Documento Base",
    "FechaPE": "Fecha Documento P/E",
}
REPORT_TRACKING_IMPORTED = {
    "Producto": "Producto",
    "Sucursal": "Sucursal",
    "RazonSocial": "Razón Social Proveedor",
    "Motivo": "Motivo Compra",
    "FechaOC": "Fecha Orden de Compra",
    "NOC": "N° Orden de Compra",
    "Cantidad": "Cantidad",
    "EstadoDoc": "Estado Documento Base",
    "FechaDoc": "Fecha Documento Base",
    "FechaPE": "Fecha Documento Recepción",
    "EstadoOC": "Estado Documento Recepción",
}
REPORT_TRACKING_BORDER = {
    "Producto": "Producto",
    "NombreLocal": "Nombre Local",
    "RazonSocial": "Razón Social Proveedor",
    "Cantidad": "Cantidad",
    "EstadoDoc": "Estado Documento Base",
    "FechaDoc": "Fecha Documento Base",
    "FechaOC": "Fecha Documento Base",
    "NOC": "N° Documento Base",
    "FechaPE": "Fecha Recepción",
}
REPORT_SALES = {
    "Producto": "Producto",
    "SUCURSAL": "SUCURSAL",
    "Tipo-Venta": "Tipo-Venta",
    "Fecha": "Fecha",
    "Cantidad": "Cantidad",
    "tipoDocto": "tipoDocto",
    "tipoproducto": "tipoproducto",
    "Empresa": "Empresa",
    "Descripcion Producto": "Descripcion Producto",
}
REPORT_SALES_BORDER = {
    "producto": "producto",
    "SUCURSAL": "SUCURSAL",
    "Tipo-Venta": "Tipo-Venta",
    "fecha": "fecha",
    "cantidad": "cantidad",
    "Documento": "Documento",
    "Docto-Emitido": "Docto-Emitido",
    "tipoproducto": "tipoproducto",
}
REPORT_MIX = {
    "Producto": "Producto",
    "Reem1": "Reem1",
    "Reem2": "Reem2",
    "Reem3": "Reem3",
}

# Warehouse to branch (matched in lower case)
WAREHOUSE_BRANCH = {
    'AUTOPARK': 'AUTOPARK',
    'BDGA. GRAN AVENIDA': 'GRAN AVENIDA',
    'BODEGA DAÑADOS': 'BODEGA DANADOS',
    "BODEGA DAÃ'ADOS": 'BODEGA DANADOS',
    'BODEGA DEVOLUCION': 'BODEGA DEVOLUCION',
    'BODEGA DYP CHILLAN V': 'CHILLAN VIEJO',
    'BODEGA DYP CURICO': 'CURICO',
    'BODEGA DYP PLACILLA': 'PLACILLA',
    'BODEGA DYP TALCA': 'TALCA',
    'BODEGA DYP TALCA 2': 'TALCA (2)',
    'BODEGA IMPORTACION': 'BODEGA IMPORTACION',
    'BODEGA ML': 'CD REPUESTOS',
    'BODEGA ML-FULL': 'CD REPUESTOS',
    'BODEGA SCRAP': 'BODEGA SCRAP',
    'BRASIL 18': 'BRASIL 18',
    'CD REPUESTOS': 'CD REPUESTOS',
    'CHILLAN': 'CHILLAN',
    'CHILLAN2': 'CHILLAN VIEJO',
    'COMEX': 'COMEX',
    'CURICO': 'CURICO',
    'DIEZ DE JULIO': 'DIEZ DE JULIO',
    'DIEZ DE JULIO (2)': 'DIEZ DE JULIO (2)',
    'IMPORTACION MOTOS': 'IMPORTACION MOTOS',
    'LA FLORIDA': 'LA FLORIDA',
    'LINDEROS': 'LINDEROS',
    'LO BLANCO': 'LO BLANCO',
    'LO BLANCO 2': 'LO BLANCO',
    'MALL PLAZA NORTE': 'MALL PLAZA NORTE',
    'MALL PLAZA SUR': 'MALL PLAZA SUR',
    'OVALLE': 'OVALLE',
    'PE X REGULARIZAR': 'PE X REGULARIZAR',
    'PE-FALTANTE': 'PE FALTANTE',
    'PLACILLA': 'PLACILLA',
    'RANCAGUA': 'RANCAGUA',
    'RANCAGUA 2': 'RANCAGUA',
    'RANCAGUA 3': 'RANCAGUA',
    'ST_RANCAGUA': 'RANCAGUA',
    'TALCA': 'TALCA',
    'TALCA (2)': 'TALCA (2)',
    'TALCA BMW': 'TALCA',
    'TRANSITO': 'TRANSITO',
}

# Branch dimension: id, name, code, region, kind, operating
BRANCH_ROWS = (
    ("LA FLORIDA", "La Florida", "SUC010", "RM", "Comercial", True),
    ("CHILLAN", "Chillán", "SUC020", "Nuble", "Comercial", True),
    ("CHILLAN VIEJO", "Chillán Viejo", "SUC030", "Nuble", "Comercial", True),
    ("COQUIMBO", "Coquimbo", "SUC040", "Coquimbo", "Comercial", True),
    ("CURICO", "Curicó", "SUC050", "Maule", "Comercial", True),
    ("DIEZ DE JULIO", "Diez de Julio", "SUC060", "RM", "Comercial", True),
    ("LINDEROS", "Linderos", "SUC070", "RM", "Comercial", True),
    ("LIRA", "Lira", "SUC080", "RM", "Comercial", True),
    ("OVALLE MALL", "Ovalle Mall", "SUC090", "Coquimbo", "Comercial", True),
    ("OVALLE 2", "Ovalle (2)", "SUC100", "Coquimbo", "Comercial", True),
    ("LO BLANCO", "Lo Blanco", "SUC110", "RM", "Comercial", True),
    ("PLACILLA", "Placilla", "SUC120", "OHiggins", "Comercial", True),
    ("RANCAGUA", "Rancagua", "SUC130", "OHiggins", "Comercial", True),
    ("SAN FERNANDO", "San Fernando", "SUC140", "OHiggins", "Comercial", True),
    ("TALCA", "Talca", "SUC150", "Maule", "Comercial", True),
    ("TALCA 2", "Talca (2)", "SUC160", "Maule", "Comercial", True),
    ("AUTOSHOPPING", "Autoshopping", "SUC170", "RM", "Comercial", True),
    ("WEB", "Web", "SUC180", "RM", "Comercial", True),
    ("RANCAGUA USADOS", "Rancagua Usados", "SUC190", "OHiggins", "Comercial", True),
    ("CASA MATRIZ", "Casa Matriz", "SUC200", "RM", "CD", True),
    ("OVALLE 3", "Ovalle (3)", "SUC210", "Coquimbo", "Comercial", True),
    ("CORONEL", "Coronel", "SUC220", "BioBio", "Comercial", True),
    ("MALL PLAZA NORTE", "Mall Plaza Norte", "SUC230", "RM", "Comercial", True),
    ("BRASIL 18", "Brasil 18", "SUC250", "RM", "Comercial", True),
    ("CONCEPCION", "Concepción", "SUC260", "BioBio", "Comercial", True),
    ("GRAN AVENIDA", "Gran Avenida", "SUC270", "RM", "Comercial", True),
    ("CD REPUESTOS", "Centro Distribución Repuestos", "SUC280", "RM", "CD", True),
    ("LA SERENA", "La Serena", "SUC290", "Coquimbo", "Comercial", True),
    ("MAIPU", "Maipú", "SUC300", "RM", "Comercial", True),
    ("RANCAGUA 2", "Rancagua 2", "SUC310", "OHiggins", "Comercial", True),
    ("TALCA 3", "Talca 3", "SUC320", "Maule", "Comercial", True),
    ("MALL PLAZA VESPUCIO", "Mall Plaza Vespucio", "SUC330", "RM", "Comercial", True),
    ("MALL PLAZA NORTE 2", "Mall Plaza Norte 2", "SUC340", "RM", "Comercial", True),
    ("MALL PLAZA SUR", "Mall Plaza Sur", "SUC350", "RM", "Comercial", True),
    ("OFICINAS CENTRALES", "Oficinas Centrales", "SUC360", "RM", "CD", True),
    ("VICUNA MACKENNA", "Vicuña Mackenna", "SUC370", "RM", "Comercial", True),
    ("AUTOPARK", "Autopark", "SUC380", "RM", "Comercial", True),
    ("FLOTA", "Flota", "SUC390", "RM", "Comercial", True),
    ("CURICO 2", "Curicó 2", "SUC400", "Maule", "Comercial", True),
    ("MALL PLAZA EGANA", "Mall Plaza Eñaga", "SUC420", "RM", "Comercial", True),
    ("CANAL DIGITAL", "Canal Digital", "SUC430", "RM", "Comercial", True),
    ("OVALLE", "Ovalle", None, "Coquimbo", "Comercial", True),
    ("BODEGA DANADOS", "Bodega Dañados", None, None, "Virtual", False),
    ("BODEGA DEVOLUCION", "Bodega Devolución", None, None, "Virtual", False),
    ("BODEGA ML", "Bodega Mercado Libre", None, None, "Virtual", False),
    ("BODEGA SCRAP", "Bodega Scrap", None, None, "Virtual", False),
    ("BODEGA IMPORTACION", "Bodega Importación", None, None, "Virtual", False),
    ("COMEX", "Comex", None, None, "Virtual", False),
    ("IMPORTACION MOTOS", "Importación Motos", None, None, "Virtual", False),
    ("PE X REGULARIZAR", "PE por Regularizar", None, None, "Virtual", False),
    ("PE FALTANTE", "PE Faltante", None, None, "Virtual", False),
    ("TRANSITO", "Tránsito", None, None, "Virtual", False),
    ("DESCONOCIDO", "Sin Asignar", None, None, "Revisar", False),
)
BRANCH_NAME_FALLBACK = {
    "TALCA (2)": "Talca (2)",
    "DIEZ DE JULIO (2)": "Diez de Julio (2)",
    "LINDEROS VTA MOVIL": "LINDEROS VTA MOVIL",
}

# Rubro number to product family
RUBRO_FAMILY = {
    10: "NO REPRESENTADOS",
    11: "NO REPRESENTADOS",
    12: "NO REPRESENTADOS",
    13: "NO REPRESENTADOS",
    14: "NO REPRESENTADOS",
    15: "FORD",
    17: "FORD",
    18: "FORD",
    19: "FORD",
    20: "FORD",
    21: "LUBRICANTES",
    22: "LUBRICANTES",
    23: "LUBRICANTES",
    24: "NO REPRESENTADOS",
    25: "FORD",
    26: "LUBRICANTES",
    28: "NO REPRESENTADOS",
    29: "NO REPRESENTADOS",
    32: "NO REPRESENTADOS",
    33: "OTROS RUBROS",
    34: "BMW",
    35: "BMW",
    36: "BMW",
    37: "NO REPRESENTADOS",
    38: "NO REPRESENTADOS",
    39: "NO REPRESENTADOS",
    40: "OTROS RUBROS",
    41: "LUBRICANTES",
    58: "OTROS RUBROS",
    61: "FILTROS VARIOS",
    69: "GILDEMEISTER LIVIANOS",
    70: "CHEVROLET",
    71: "NO REPRESENTADOS",
    72: "IVECO",
    74: "NO REPRESENTADOS",
    75: "OMODA",
    80: "ACCESORIOS",
    81: "OTROS RUBROS",
    83: "GILDEMEISTER LIVIANOS",
    84: "NO REPRESENTADOS",
    86: "GILDEMEISTER LIVIANOS",
    87: "NO REPRESENTADOS",
    88: "NO REPRESENTADOS",
    89: "NO REPRESENTADOS",
    90: "NO REPRESENTADOS",
    91: "NO REPRESENTADOS",
    92: "NO REPRESENTADOS",
    93: "NO REPRESENTADOS",
    94: "GILDEMEISTER LIVIANOS",
    95: "GILDEMEISTER LIVIANOS",
    96: "GILDEMEISTER LIVIANOS",
    98: "NO REPRESENTADOS",
    99: "NO REPRESENTADOS",
    100: "NO REPRESENTADOS",
    102: "OTROS NEGOCIOS",
}

# Output contract, header and internal column
CONTRACT = (
    ("Producto", "producto_master"),
    ("Descripcion", "descripcion_cat"),
    ("SucursalID", "sucursal_final"),
    ("Nombre Sucursal", "nombre_sucursal"),
    ("Meses con Venta 3m", "m3"),
    ("Meses con Venta 6m", "m6"),
    ("Meses con Venta 12m", "m12"),
    ("Clasificacion ABC", "clasificacion_abc"),
    ("Clasificacion ABC Agregada", "clasificacion_abc_agregada"),
    ("Proveedor", "proveedor"),
    ("Lead Time Dias", "lead_time_dias"),
    ("LT Origen", "lt_origen"),
    ("LT CD a Sucursal Dias", "lt_cd_a_sucursal_dias"),
    ("LT Efectivo", "lt_efectivo"),
    ("Abastece CD", "abastece_cd"),
    ("Prioridad CD", "prioridad_cd"),
    ("Demanda Mensual", "demanda_mensual"),
    ("Desv Std Mensual", "desv_std_mensual"),
    ("Demanda Diaria", "demanda_diaria"),
    ("Stock de Seguridad", "stock_seguridad"),
    ("Costo Unitario", "costo_unitario"),
    ("Es Importado", "es_importado"),
    ("Tiene Stock CD", "tiene_stock_cd"),
    ("FILTRO1_Final", "filtro1_cat"),
    ("Unidad de Medida", "unidad_cat"),
    ("Sucursales Origen CD", "sucursales_origen_cd"),
    ("Reemplazos", "reemplazos"),
    ("Empresa", "empresa"),
    ("Pedir", "pedir"),
    ("Tipo Origen", "tipo_origen"),
    ("Punto de Pedido", "punto_pedido"),
    ("total_sugerido_suc", "sugerido"),
    ("total_valor_sugerido_clp", "valor_clp"),
    ("sugerido_suc", "sugerido"),
    ("stock_activo_suc", "stock_activo"),
    ("stock_en_transito_suc", "stock_transito"),
    ("stock_en_cd", "stock_cd"),
    ("sugerido_traslado", "sugerido_traslado"),
    ("sugerido_compra_neto", "compra_neta"),
    ("comprar_en_el_cd", "comprar_en_cd"),
    ("pedir_flag", "pedir"),
    ("trasladar_desde", "trasladar_desde"),
)

# Upload header aliases (normalised header to field) and typed fields
SUGGESTION_ALIASES = {
    "producto": "producto",
    "codigo": "producto",
    "codigo_producto": "producto",
    "descripcion": "descripcion",
    "descripcion_corta": "descripcion",
    "sucursal_id": "sucursal_id",
    "sucursalid": "sucursal_id",
    "sucursal": "sucursal_id",
    "id_sucursal": "sucursal_id",
    "nombre_sucursal": "nombre_sucursal",
    "empresa": "empresa",
    "clasificacion_abc": "clasificacion_abc",
    "abc": "clasificacion_abc",
    "proveedor": "proveedor",
    "filtro1_final": "filtro1_final",
    "filtro1": "filtro1_final",
    "marca": "filtro1_final",
    "tipo_origen": "tipo_origen",
    "es_importado": "es_importado",
    "unidad_medida": "unidad_medida",
    "unidad_de_medida": "unidad_medida",
    "lead_time_dias": "lead_time_dias",
    "lt_efectivo": "lt_efectivo",
    "lt_cd_a_sucursal_dias": "lt_cd_a_sucursal_dias",
    "lt_origen": "lt_origen",
    "abastece_cd": "abastece_cd",
    "prioridad_cd": "prioridad_cd",
    "comprar_en_el_cd": "comprar_en_el_cd",
    "tiene_stock_cd": "tiene_stock_cd",
    "demanda_mensual": "demanda_mensual",
    "demanda_diaria": "demanda_diaria",
    "desv_std_mensual": "desv_std_mensual",
    "stock_seguridad": "stock_seguridad",
    "stock_de_seguridad": "stock_seguridad",
    "punto_de_pedido": "punto_de_pedido",
    "costo_unitario": "costo_unitario",
    "pedir": "pedir",
    "reemplazos": "reemplazos",
    "sugerido_suc": "sugerido_suc",
    "stock_activo_suc": "stock_activo_suc",
    "stock_en_transito_suc": "stock_en_transito_suc",
    "stock_en_cd": "stock_en_cd",
    "sugerido_traslado": "sugerido_traslado",
    "sugerido_compra_neto": "sugerido_compra_neto",
    "total_sugerido_suc": "total_sugerido_suc",
    "total_valor_sugerido_clp": "total_valor_sugerido_clp",
    "total_valor_sugerido_suc_clp": "total_valor_sugerido_clp",
    "valor_sugerido_suc_clp": "total_valor_sugerido_clp",
    "valor_sugerido_clp": "total_valor_sugerido_clp",
    "pedir_flag": "pedir_flag",
    "trasladar_desde": "trasladar_desde",
    "traslado_desde_otras_sucursales": "trasladar_desde",
    "stock_linderos": "stock_linderos",
    "stock_curico": "stock_curico",
    "stock_talca": "stock_talca",
    "stock_rancagua": "stock_rancagua",
    "stock_diez_de_julio_2": "stock_diez_de_julio_2",
    "stock_chillan": "stock_chillan",
    "stock_cd_repuestos": "stock_cd_repuestos",
    "stock_brasil_18": "stock_brasil_18",
    "stock_placilla": "stock_placilla",
    "stock_chillan_viejo": "stock_chillan_viejo",
    "stock_talca_2": "stock_talca_2",
    "total_sugerido": "total_sugerido_suc",
    "stock_activo": "stock_activo_suc",
    "stock_en_transito": "stock_en_transito_suc",
    "comprar_en_cd": "comprar_en_el_cd",
}
SALES_ALIASES = {
    "producto": "producto",
    "codigo": "producto",
    "codigo_producto": "producto",
    "sucursal": "sucursal_id",
    "sucursal_id": "sucursal_id",
    "sucursalid": "sucursal_id",
    "nombre_sucursal": "sucursal_id",
    "periodo": "mes",
    "mes": "mes",
    "anio_mes": "mes",
    "cantidad": "cantidad",
    "cantidad_vendida": "cantidad",
    "venta": "cantidad",
    "ventas": "cantidad",
    "unidades": "cantidad",
}
STOCK_ALIASES = {
    "producto": "producto",
    "codigo": "producto",
    "bodega": "bodega",
    "sucursal": "sucursal_id",
    "sucursalid": "sucursal_id",
    "sucursal_id": "sucursal_id",
    "stock": "stock",
    "cantidad": "stock",
    "origen": "origen",
    "empresa": "origen",
}
INT_FIELDS = (
    "lead_time_dias",
    "lt_cd_a_sucursal_dias",
    "lt_efectivo",
    "prioridad_cd",
    "punto_de_pedido",
    "stock_brasil_18",
    "stock_cd_repuestos",
    "stock_chillan",
    "stock_chillan_viejo",
    "stock_curico",
    "stock_diez_de_julio_2",
    "stock_linderos",
    "stock_placilla",
    "stock_rancagua",
    "stock_seguridad",
    "stock_talca",
    "stock_talca_2",
)
FLOAT_FIELDS = (
    "costo_unitario",
    "demanda_diaria",
    "demanda_mensual",
    "desv_std_mensual",
    "stock_activo_suc",
    "stock_en_cd",
    "stock_en_transito_suc",
    "sugerido_compra_neto",
    "sugerido_suc",
    "sugerido_traslado",
    "total_sugerido_suc",
    "total_valor_sugerido_clp",
)
BOOL_FIELDS = (
    "es_importado",
    "tiene_stock_cd",
)

# Catalogue file columns
CATALOGUE_TEXT = {
    "Producto": "producto",
    "Glosa": "glosa",
    "Familia": "familia",
    "SubFamilia": "subfamilia",
    "Procedencia": "procedencia",
    "Tipo Repuesto": "tipo_repuesto",
    "Categoria": "categoria",
    "Sub Categoria": "sub_categoria",
    "TipoProducto": "tipo_producto",
    "Clasificacion Stock": "clasificacion_stock",
    "Sub-Modelo": "sub_modelo",
    "Cilindrada": "cilindrada",
    "Combustible": "combustible",
    "Año": "anio",
    "Unidad": "unidad",
    "Reemplazo": "reemplazo",
}
CATALOGUE_NUMERIC = {
    "Costo": "costo",
    "Precio": "precio",
    "Stock": "stock_total",
    "StockMinimo": "stock_minimo",
    "StockMaximo": "stock_maximo",
}

# Maximum age in days of each source
FRESHNESS_DAYS = {
    "stock_bodegas": 2,
    "stock_bodegas_frontera": 2,
    "seguimiento_curifor_nacional": 2,
    "seguimiento_curifor_importado": 7,
    "seguimiento_frontera": 7,
    "ventas_frontera": 35,
    "catalogo": 120,
    "mix_reemplazos": 120,
}

# Export labels and default export columns
EXPORT_LABELS = {
    "producto": "Producto",
    "empresa": "Empresa",
    "descripcion": "Descripcion",
    "clasificacion_abc": "ABC",
    "nombre_sucursal": "Sucursal",
    "sucursal_id": "ID Sucursal",
    "proveedor": "Proveedor",
    "filtro1_final": "Marca",
    "tipo_origen": "Tipo Origen",
    "unidad_medida": "Unidad",
    "lead_time_dias": "Lead Time (dias)",
    "lt_efectivo": "LT Efectivo",
    "lt_origen": "Origen LT",
    "abastece_cd": "Abastece CD",
    "prioridad_cd": "Prioridad CD",
    "comprar_en_el_cd": "Comprar en el CD",
    "demanda_mensual": "Demanda Mensual",
    "demanda_diaria": "Demanda Diaria",
    "desv_std_mensual": "Desv Std Mensual",
    "stock_seguridad": "Stock Seguridad",
    "punto_de_pedido": "Punto de Pedido",
    "costo_unitario": "Costo Unitario",
    "pedir": "Pedir",
    "stock_activo_suc": "Stock Activo",
    "stock_en_transito_suc": "Stock en Transito",
    "stock_en_cd": "Stock en CD",
    "sugerido_traslado": "Sugerido Traslado",
    "sugerido_compra_neto": "Sugerido Compra Neto",
    "total_sugerido_suc": "Total Sugerido",
    "total_valor_sugerido_clp": "Valor Total CLP",
    "reemplazos": "Reemplazos",
    "trasladar_desde": "Trasladar desde",
    "stock_linderos": "Stock Linderos",
    "stock_curico": "Stock Curico",
    "stock_talca": "Stock Talca",
    "stock_rancagua": "Stock Rancagua",
    "stock_diez_de_julio_2": "Stock Diez de Julio (2)",
    "stock_chillan": "Stock Chillan",
    "stock_cd_repuestos": "Stock CD Repuestos",
    "stock_brasil_18": "Stock Brasil 18",
    "stock_placilla": "Stock Placilla",
    "stock_chillan_viejo": "Stock Chillan Viejo",
    "stock_talca_2": "Stock Talca (2)",
}
EXPORT_DEFAULT = (
    "producto",
    "descripcion",
    "clasificacion_abc",
    "nombre_sucursal",
    "proveedor",
    "total_sugerido_suc",
    "total_valor_sugerido_clp",
)

# Post-sale sheet
POSTSALE_NUMERIC = (
    "cantidad",
    "costo_neto",
    "items",
    "neto",
    "total",
    "total_neta",
)
SHEET_MAX_ROWS = 1048575

# Internal product code prefixes never listed
HIDDEN_PREFIXES = (
    "D&P",
    "MEC INSUMOS",
    "INCENTIVOS",
    "APLICA-DED",
)

# Fixed values of the border extract, in the order in which they are tried.
SERIES_PATTERNS = (
    ("            %", "MESON"),
    ("%NKR%", "SERIE N"),
    ("%NPR%", "SERIE N"),
    ("%NQR%", "SERIE N"),
    ("%FRR%", "SERIE F"),
    ("%FTR%", "SERIE F"),
    ("%FVR%", "SERIE F"),
    ("%DMAX%", "LIVIANOS"),
    ("%COLORADO%", "LIVIANOS"),
)
SERIES_OTHER = "OTROS"
LUBRICANT_CODES = ("2723982", "2722295", "2722260", "2723053", "2722278", "2722289")
EXTRACT_BRANCHES = {
    "CASA MATRIZ": "01 LA FLORIDA",
    "SUC010": "01 LA FLORIDA",
    "LO BLANCO": "01 LO BLANCO",
    "SUC110": "01 LO BLANCO",
    "LINDEROS": "02 LINDEROS",
    "SUC070": "02 LINDEROS",
    "PLACILLA": "03 PLACILLA",
    "SUC120": "03 PLACILLA",
    "COQUIMBO": "04 COQUIMBO",
    "SUC040": "04 COQUIMBO",
    "RANCAGUA": "05 RANCAGUA",
    "SUC130": "05 RANCAGUA",
    "RANCAGUA2": "06 RANCAGUA2",
    "SUC190": "06 RANCAGUA2",
    "CURICO": "07 CURICO",
    "SUC050": "07 CURICO",
    "TALCA": "08 TALCA",
    "SUC150": "08 TALCA",
    "CHILLAN": "09 CHILLAN",
    "SUC020": "09 CHILLAN",
    "CHILLAN VIEJO": "10 CHILLAN VIEJO",
    "SUC030": "10 CHILLAN VIEJO",
    "SAN FERNANDO": "11 SAN FERNANDO",
    "SUC140": "11 SAN FERNANDO",
    "DIEZ DE JULIO": "12 DIEZ DE JULIO",
    "SUC060": "12 DIEZ DE JULIO",
}
EXTRACT_BRANCH_OTHER = "99 Ver Sucursal"
CREDIT_DOCUMENT = "NOTA CREDITO ST"
EXTRACT_DOCUMENTS = (
    "FACTURA REPUESTOS (E)",
    "FACTURA ST",
    "CARGO INTERNO",
    "CARGO GARANTIA",
    "NOTA CREDITO ST",
    "REFACTURACION ST",
    "REFACTURACION C/RS",
)
ISSUABLE_DOCUMENTS = (
    "FACTURA ST",
    "FACTURA REPUESTOS (E)",
    "NOTA CREDITO ST",
    "REFACTURACION ST",
    "REFACTURACION C/RS",
)
