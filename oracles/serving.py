"""Sources, dimensions, serving and state restated in SQL."""

from __future__ import annotations

from oracles.common import statement
from oracles.engine import CTES as ENGINE

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
# How a number is spelled with dot thousands and decimal comma.
LOCAL = "translate(format('{{:,.2f}}', {0}), ',.', '.,')"


def local(column: str) -> str:
    return LOCAL.format(column)


HIDDEN = "NOT (lower(producto) LIKE '13 brand#1%' OR lower(producto) LIKE '14 brand#2%')"
VIA_CD = "coalesce(lower(abastece_cd) IN ('si', 'sí'), false)"
ACTIVE = f"NOT archivada AND (expira_en IS NULL OR expira_en > {NOW})"

CTES = {
    **ENGINE,
    "sg0": """
      SELECT producto, n_name AS sucursal_id, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS id, arg_min(p_name, p_partkey) AS descripcion,
             arg_min(s_name, s_suppkey) AS prov, any_value(p_brand) AS filtro1_final, arg_min(p_type, p_partkey) AS unidad_medida, max(p_retailprice) AS co, sum(l_quantity) AS q,
             sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS total_sugerido_suc,
             sum(l_quantity) FILTER (WHERE l_tax > 0.07) AS stock_activo_suc, sum(l_quantity) FILTER (WHERE l_tax < 0.01) AS stock_en_transito_suc
      FROM lin GROUP BY producto, n_name""",
    "sgx": """
      SELECT *, 'Suc ' || sucursal_id AS nombre_sucursal, substr('ABCD', n % 4 + 1, 1) AS clasificacion_abc,
             CASE WHEN n % 11 <> 0 THEN prov END AS proveedor,
             CASE WHEN filtro1_final IN ('Brand#1', 'Brand#2') THEN 'Importado' ELSE 'Nacional' END AS tipo_origen,
             CASE WHEN n % 5 <> 0 THEN filtro1_final IN ('Brand#1', 'Brand#2') END AS es_importado,
             CASE WHEN n % 3 = 0 THEN 'Si' WHEN n % 3 = 1 THEN 'No' END AS abastece_cd,
             q / 84 AS demanda_mensual, CASE WHEN n % 7 <> 0 THEN q / 84 / 22 END AS demanda_diaria, n % 9 AS lt_efectivo,
             CAST(floor(q / 100) AS BIGINT) AS stock_seguridad, CASE WHEN n % 13 <> 0 THEN co END AS costo_unitario,
             CASE WHEN n % 6 = 0 THEN floor(total_sugerido_suc / 2) END AS sugerido_traslado,
             CASE WHEN n % 10 = 0 THEN 0.0::DOUBLE WHEN n % 10 <> 1 THEN total_sugerido_suc - coalesce(CASE WHEN n % 6 = 0 THEN floor(total_sugerido_suc / 2) END, 0) END AS sugerido_compra_neto,
             total_sugerido_suc * CASE WHEN n % 13 <> 0 THEN co END AS total_valor_sugerido_clp,
             CASE WHEN total_sugerido_suc > 0 THEN 'Si' ELSE 'No' END AS pedir, CASE WHEN total_sugerido_suc > 0 THEN 'Si' ELSE 'No' END AS pedir_flag,
             CASE WHEN n % 2 = 1 THEN '' END AS reemplazos
      FROM sg0""",
    "vis": f"SELECT * FROM sgx WHERE {HIDDEN}",
    "ped": "SELECT * FROM vis WHERE pedir = 'Si'",
    "ctg": """
      SELECT producto, min(p_name) AS glosa, min(p_type) AS familia, CASE WHEN min(p_partkey) % 3 = 0 THEN 'IMPORTADO' ELSE 'NACIONAL' END AS procedencia,
             max(p_brand) AS categoria, max(p_retailprice) AS costo, 'UN' AS unidad, 'R-' || min(p_partkey) AS reemplazo, CAST(sum(p_size - 25) AS DOUBLE) AS stock_total
      FROM (SELECT * FROM pt UNION ALL SELECT * REPLACE ('X' || p_partkey AS producto) FROM pt) GROUP BY producto""",
    "stu": """
      SELECT producto, 'B' || (l_orderkey % 3) AS bodega, n_name AS sucursal_id, CASE WHEN l_linestatus = 'O' AND s_nationkey % 5 = 0 THEN 'B' ELSE 'M' END AS origen,
             sum(l_quantity) AS stock FROM lin GROUP BY ALL""",
    "vm": """
      SELECT producto, n_name AS sucursal_id, strftime(l_shipdate, '%Y%m') AS mes, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS cantidad
      FROM lin GROUP BY ALL""",
    "ev": """
      SELECT e.*, date_trunc('second', ts) AS cuando, CASE WHEN event_id % 9 = 0 THEN 'X' || user_id ELSE p.producto END AS producto, 'NATION_' || (event_id % 25) AS sucursal_id
      FROM events e JOIN pt p ON user_id = p_partkey""",
    "man": """
      SELECT 'M' || event_id AS id, producto, sucursal_id, CAST(ceil(value) AS BIGINT) AS unidades, 'ana' AS creado_por, cuando AS creado_en,
             event_id % 7 = 0 AS archivada, CASE WHEN event_id % 5 = 0 THEN 'R' || (event_id % 500) END AS recurrente_id,
             CASE WHEN event_id % 3 = 0 THEN 'L' || (event_id % 20) END AS lote_id,
             CASE WHEN event_id % 4 <> 0 THEN date_trunc('day', ts) + to_days(CAST(ceil(value) AS INTEGER)) END AS expira_en
      FROM ev WHERE event_type = 'purchase'""",
    "act": f"SELECT producto, sucursal_id, sum(unidades) AS u FROM man WHERE {ACTIVE} GROUP BY ALL",
    "reglas": """
      SELECT 'R' || event_id AS id, event_id AS e, CASE WHEN event_id % 3 = 0 THEN 'grupo' ELSE 'individual' END AS modo, producto, sucursal_id,
             event_id % 5 + 1 AS unidades, CASE WHEN event_id % 4 = 0 THEN 60 END AS dias, CAST(event_id % 7 + 1 AS INTEGER) AS cada,
             CAST(ts AS DATE) AS proxima, CASE WHEN event_id % 5 = 0 THEN CAST(ts AS DATE) + CAST(event_id % 30 AS INTEGER) END AS fin, event_id % 6 <> 0 AS activa
      FROM ev WHERE event_type = 'signup'""",
    "avance": """
      SELECT *, activa AND proxima <= DATE '2024-01-20' AS turno, coalesce(fin < DATE '2024-01-20', false) AS pasada FROM reglas""",
    "corren": "SELECT * FROM avance WHERE turno AND NOT pasada",
    "blancos": """
      SELECT r.id AS regla, r.unidades AS ur, r.dias, r.producto, r.sucursal_id, s.demanda_diaria FROM corren r
      LEFT JOIN sgx s ON s.producto = r.producto AND s.sucursal_id = r.sucursal_id WHERE modo = 'individual'
      UNION ALL
      SELECT r.id, r.unidades, r.dias, s.producto, s.sucursal_id, s.demanda_diaria FROM corren r JOIN vis s
        ON s.filtro1_final = 'Brand#' || (e % 25 + 1)
       AND CASE WHEN e % 2 = 0 THEN s.nombre_sucursal = 'Suc NATION_' || (e % 25) AND s.clasificacion_abc IN ('A', 'B') AND s.pedir = 'Si'
                ELSE s.clasificacion_abc = 'C' AND s.sucursal_id <> 'NATION_0' AND NOT coalesce(s.abastece_cd = 'Si', false) END
      WHERE modo = 'grupo'""",
    "nuevas": """
      SELECT regla || ':2024-01-20:' || producto || ':' || sucursal_id AS id, producto, sucursal_id,
             CASE WHEN dias > 0 THEN CASE WHEN demanda_diaria > 0 THEN greatest(1, CAST(ceil(demanda_diaria * dias) AS BIGINT)) END ELSE ur END AS unidades, regla
      FROM blancos""",
    "aud": "SELECT event_id AS id, event_type AS accion, date_trunc('second', ts) AS creado_en, props AS detalle FROM events",
    "noti": """
      SELECT CAST(event_id AS VARCHAR) AS id, event_id, date_trunc('second', ts) AS creado_en,
             CASE WHEN event_id % 4 <> 0 THEN CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'ana,beto' ELSE ' caro , ana,' END END AS vistas_por
      FROM events WHERE event_type = 'error'""",
    "leen": """
      SELECT *, list_sort(list_filter([trim(x) FOR x IN string_split(coalesce(vistas_por, ''), ',')], lambda x: x <> '')) AS lectores FROM noti""",
    "hoja0": f"""
      SELECT o_orderkey AS id, [CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y%m') ELSE ' ' END, 'SUC' || n_nationkey,
             CASE WHEN o_orderkey % 40 <> 0 THEN ' ' || n_name ELSE '' END, o_orderpriority,
             CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'sin fecha' END,
             CAST(o_orderkey % 9 AS VARCHAR), format('{{:.2f}}', o_totalprice), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {local("o_totalprice")} END] AS c,
             CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE)
                  WHEN 1 THEN CASE WHEN day(o_orderdate) <= 12 THEN make_date(CAST(year(o_orderdate) AS INTEGER), CAST(day(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER)) ELSE CAST(o_orderdate AS DATE) END
                  WHEN 2 THEN CAST(o_orderdate AS DATE) END AS dia,
             CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) ELSE 0 END AS neta, o_orderkey % 9 AS cant, o_totalprice
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "hoja": """
      SELECT *, nullif(trim(c[1]), '') AS periodo, nullif(trim(c[3]), '') AS sucursal, CAST(to_json(c) AS VARCHAR) AS datos FROM hoja0""",
    "resumen": """
      SELECT periodo, sucursal, CAST(sum(neta) AS DOUBLE) AS total_clp, CAST(sum(cant) AS DOUBLE) AS total_unidades, count(*) AS n_lineas
      FROM hoja WHERE periodo IS NOT NULL GROUP BY ALL""",
    "porper": "SELECT periodo, sum(total_clp) AS clp, sum(total_unidades) AS unidades, CAST(sum(n_lineas) AS BIGINT) AS n_lineas FROM resumen GROUP BY periodo",
    "lineas": """
      SELECT * FROM hoja WHERE periodo >= '199803' AND periodo <= '199807' AND datos ILIKE '%urgent%'
        AND (dia IS NULL OR (dia >= DATE '1998-03-05' AND dia <= DATE '1998-07-20'))""",
    "serie_g": """
      SELECT producto, mes, sum(cantidad) AS g, row_number() OVER (PARTITION BY producto ORDER BY mes DESC) AS r FROM vm GROUP BY producto, mes""",
    "serie_s": """
      SELECT producto, mes, sum(cantidad) AS g, row_number() OVER (PARTITION BY producto ORDER BY mes DESC) AS r FROM vm WHERE sucursal_id = 'NATION_4' GROUP BY producto, mes""",
    "s12": """
      SELECT coalesce(a.producto, b.producto) AS producto, coalesce(a.mes, b.mes) AS mes, coalesce(a.g, 0.0::DOUBLE) AS cantidad_general, coalesce(b.g, 0.0::DOUBLE) AS cantidad_sucursal
      FROM (SELECT * FROM serie_g WHERE r <= 12) a FULL JOIN (SELECT * FROM serie_s WHERE r <= 12) b ON a.producto = b.producto AND a.mes = b.mes""",
    "carro": f"""
      SELECT proveedor, s.producto, max(descripcion) AS descripcion, max(clasificacion_abc) AS clasificacion_abc, max(costo_unitario) AS costo_unitario,
             sum(coalesce(sugerido_compra_neto, total_sugerido_suc, 0) + coalesce(u, 0)) AS cantidad
      FROM ped s LEFT JOIN act a ON a.producto = s.producto AND a.sucursal_id = s.sucursal_id WHERE proveedor IS NOT NULL
      GROUP BY proveedor, s.producto HAVING sum(coalesce(sugerido_compra_neto, total_sugerido_suc, 0) + coalesce(u, 0)) > 0
      UNION ALL
      SELECT 'Sin proveedor asignado', m.producto, glosa, NULL, costo, m.c FROM (
        SELECT producto, CAST(sum(unidades) AS DOUBLE) AS c FROM man WHERE {ACTIVE} GROUP BY producto HAVING sum(unidades) > 0) m
      LEFT JOIN ctg ON ctg.producto = m.producto WHERE m.producto NOT IN (SELECT producto FROM sgx)""",
    "carro_a": """
      SELECT proveedor, s.producto, max(costo_unitario) AS costo_unitario,
             sum(coalesce(sugerido_compra_neto, total_sugerido_suc, 0) + coalesce(u, 0)) AS cantidad
      FROM ped s LEFT JOIN act a ON a.producto = s.producto AND a.sucursal_id = s.sucursal_id WHERE proveedor IS NOT NULL AND clasificacion_abc = 'A'
      GROUP BY proveedor, s.producto HAVING sum(coalesce(sugerido_compra_neto, total_sugerido_suc, 0) + coalesce(u, 0)) > 0""",
    "conman": """
      SELECT s.producto, s.sucursal_id, CASE WHEN u > 0 THEN coalesce(total_sugerido_suc, 0) + u ELSE total_sugerido_suc END AS total_sugerido_suc,
             CASE WHEN u > 0 THEN coalesce(nullif(sugerido_compra_neto, 0), coalesce(total_sugerido_suc, 0) + u) + u ELSE sugerido_compra_neto END AS sugerido_compra_neto,
             CASE WHEN u > 0 AND costo_unitario <> 0 THEN coalesce(total_valor_sugerido_clp, 0) + u * costo_unitario ELSE total_valor_sugerido_clp END AS total_valor_sugerido_clp,
             CASE WHEN u > 0 THEN 'Si' ELSE pedir END AS pedir, CASE WHEN u > 0 THEN 'Si' ELSE pedir_flag END AS pedir_flag, id, reemplazos, demanda_mensual, stock_activo_suc
      FROM sgx s LEFT JOIN act a ON a.producto = s.producto AND a.sucursal_id = s.sucursal_id""",
    "v1": "SELECT *, producto || '@' || sucursal_id AS k FROM sgx WHERE lt_efectivo <> 3",
    "v2": """
      SELECT producto || '@' || sucursal_id AS k, producto, sucursal_id, CASE WHEN lt_efectivo = 5 THEN total_sugerido_suc + 1 ELSE total_sugerido_suc END AS total_sugerido_suc,
             CASE WHEN lt_efectivo = 6 THEN 'No' ELSE pedir END AS pedir FROM sgx WHERE lt_efectivo <> 4""",
    "sombra": """
      SELECT coalesce(a.producto, b.producto) AS producto, coalesce(a.sucursal_id, b.sucursal_id) AS sucursal_id, b.total_sugerido_suc AS motor, a.total_sugerido_suc AS oficial,
             abs(coalesce(b.total_sugerido_suc, 0) - coalesce(a.total_sugerido_suc, 0)) AS diferencia,
             CASE WHEN a.k IS NULL THEN 'solo_motor' WHEN b.k IS NULL THEN 'solo_oficial'
                  WHEN abs(coalesce(b.total_sugerido_suc, 0) - coalesce(a.total_sugerido_suc, 0)) <= 0.5 THEN 'igual' ELSE 'distinta' END AS estado
      FROM v1 a FULL JOIN v2 b ON a.k = b.k""",
    "valores": "SELECT DISTINCT producto AS valor FROM sgx",
    "codigos": "SELECT unnest(['11 Brand#2', '1 brand#1', 'RAND#25', 'nada', '7 Brand#2', '50']) AS codigo",
    "calce": """
      SELECT codigo, valor, CASE WHEN lower(valor) = lower(codigo) THEN 0 WHEN starts_with(lower(valor), lower(codigo)) THEN 1 ELSE 2 END AS r
      FROM codigos JOIN valores ON contains(lower(valor), lower(codigo))""",
    "mejor": """
      SELECT c.codigo, k.valor, CASE r WHEN 0 THEN 'exacto' WHEN 1 THEN 'prefijo' WHEN 2 THEN 'contiene' END AS tipo FROM codigos c
      LEFT JOIN (SELECT * FROM calce QUALIFY r = min(r) OVER (PARTITION BY codigo)) k ON k.codigo = c.codigo""",
    "enlaces": """
      SELECT 'K' || p_partkey AS master, unnest(list_filter([CASE WHEN p_partkey % 4 = 0 OR p_partkey % 40 = 1 THEN 'K' || (p_partkey + 1) WHEN p_partkey % 60 = 58 THEN 'K' || (p_partkey + 3) END,
             CASE WHEN p_partkey % 8 = 0 THEN 'K' || (p_partkey + 2) END, CASE WHEN p_partkey % 16 = 0 THEN 'K' || (p_partkey + 3) END], lambda x: x IS NOT NULL)) AS reem FROM part""",
    "limpios": "SELECT * FROM enlaces WHERE master NOT IN (SELECT reem FROM enlaces)",
    "firmes": """
      SELECT * FROM limpios WHERE master NOT IN (
        SELECT master FROM limpios WHERE reem IN (SELECT reem FROM limpios GROUP BY reem HAVING count(DISTINCT master) > 1))""",
    "grupo": "SELECT master, master AS producto FROM firmes UNION SELECT master, reem FROM firmes",
    "vendido": """
      SELECT 'K' || l_partkey AS producto, sum(CAST(l_quantity AS BIGINT)) AS u FROM lineitem
      WHERE CAST(l_shipdate AS DATE) >= DATE '2001-05-01' AND CAST(l_shipdate AS DATE) < DATE '2001-11-01' GROUP BY 1""",
    "cabeza": """
      SELECT g.master, arg_max(g.producto, (coalesce(u, 0), CAST(g.producto = g.master AS INTEGER), g.producto)) AS jefe
      FROM grupo g LEFT JOIN vendido v ON v.producto = g.producto GROUP BY g.master""",
    "marcas": """
      SELECT DISTINCT producto, unnest(list_filter([CASE WHEN clasificacion_abc = 'A' THEN 1 END, CASE WHEN tipo_origen = 'Importado' THEN 2 END,
             CASE WHEN sucursal_id = 'NATION_0' THEN 3 END, CASE WHEN total_sugerido_suc > 100 THEN 4 END], lambda x: x IS NOT NULL)) AS c FROM sgx""",
    "elegidos": """
      SELECT DISTINCT producto FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY producto) AS r FROM marcas)
      WHERE r <= CASE c WHEN 1 THEN 8 WHEN 2 THEN 10 WHEN 3 THEN 12 ELSE 15 END""",
    "docs": """
      SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'E01' ELSE 'E07' END AS empresa,
             coalesce(['FACTURA REPUESTOS (E)', 'FACTURA ST', 'CARGO INTERNO', 'CARGO GARANTIA', 'NOTA CREDITO ST', 'REFACTURACION ST', 'REFACTURACION C/RS'][o_orderkey % 9 + 1], 'OTRO') AS docto
      FROM orders""",
}


def page(order: str, offset: int, limit: int) -> str:
    return f"ORDER BY {order} LIMIT {limit} OFFSET {offset}"


SOLD_BEFORE = "(SELECT producto, sucursal_id, sum(cantidad) AS v FROM vm WHERE mes = '{0}' GROUP BY ALL)"
STOPPED = "demanda_mensual > 0 AND stock_activo_suc >= demanda_mensual AND coalesce(x.v, 0) <= 0"


def grouped(column: str, source: str = "ped", n: int = 15) -> str:
    return f"""SELECT {column} AS grupo, coalesce(sum(total_sugerido_suc), 0) AS total_sugerido, round(coalesce(sum(total_valor_sugerido_clp), 0), 2) AS valor_clp,
        count(DISTINCT producto) AS n_productos FROM {source} WHERE {column} IS NOT NULL GROUP BY ALL ORDER BY coalesce(sum(total_valor_sugerido_clp), 0) DESC, grupo LIMIT {n}"""


KPIS = """coalesce(sum(total_sugerido_suc), 0) AS total_sugerido, round(coalesce(sum(total_valor_sugerido_clp), 0), 2) AS valor_total_clp,
          count(DISTINCT producto) AS n_productos, count(DISTINCT proveedor) AS n_proveedores"""
DIMP = """(SELECT producto, arg_min(descripcion, fila) AS descripcion, arg_min(unidad_medida, fila) AS unidad_medida
           FROM (SELECT *, id * 100 + CAST(substr(sucursal_id, 8, 3) AS BIGINT) AS fila FROM sgx) GROUP BY producto)"""
MATCH7 = "(producto ILIKE '%brand#7%' OR {0} ILIKE '%brand#7%')"
LABEL = "lower('Año ' || p_name || ' / N° (%) ' || p_brand)"

BODIES = {
    "text_numbers": f"""SELECT p_partkey, round(p_retailprice, 2) AS es_cl,
        CASE WHEN p_retailprice >= 1000 THEN round(CAST(replace(replace(format('{{:,.2f}}', p_retailprice), '.', ''), ',', '.') AS DOUBLE), 2) ELSE round(p_retailprice, 2) END AS con_miles,
        round(p_retailprice, 2) AS subida, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS marca,
        CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS al_par, CAST(floor(p_size / 3.0) AS BIGINT) AS entero,
        regexp_replace(replace({LABEL}, 'ñ', 'n'), '[^a-z0-9]', '', 'g') AS clave_compacta,
        trim(regexp_replace(regexp_replace(regexp_replace(replace({LABEL}, 'ñ', 'n'), '[?()%$]', '', 'g'), '[ \\-/.]', '_', 'g'), '_+', '_', 'g'), '_') AS clave_subida,
        trim(regexp_replace(regexp_replace(replace({LABEL}, 'ñ', 'n'), '[ \\-/.°]', '_', 'g'), '_+', '_', 'g'), '_') AS clave_planilla FROM part""",
    "sales_report": """SELECT producto AS "Producto", n_name AS "SUCURSAL", CASE WHEN l_suppkey % 4 = 2 THEN 'VTA MESON' ELSE 'VTA MESON' END AS "Tipo-Venta",
        CAST(l_shipdate AS DATE) AS "Fecha", CAST(l_quantity AS BIGINT) AS "Cantidad", CASE WHEN l_returnflag = 'R' THEN 'NC LIQ FACT' ELSE 'FACTURA' END AS "tipoDocto",
        CASE WHEN l_linenumber = 7 THEN '1M.O.' ELSE 'REPUESTOS' END AS tipoproducto FROM lin""",
    "report_without_header": "SELECT DISTINCT 'informe_' || (n_nationkey % 4) AS archivo FROM nation WHERE n_nationkey % 4 = 3",
    "upload_stock": """SELECT 'stock_' || (l_suppkey % 3) AS archivo, producto, 'B' || (l_orderkey % 3) AS bodega,
        CASE WHEN l_suppkey % 3 < 2 THEN n_name END AS sucursal_id, round(l_extendedprice, 2) AS stock,
        CASE WHEN l_linenumber > 3 THEN 'M' END AS origen FROM lin""",
    "upload_ignored": """SELECT * FROM (VALUES ('stock_0', 'Nota'), ('stock_2', 'otro %'), ('stock_2', 'Codigo-Producto')) t(archivo, columna) WHERE EXISTS (SELECT 1 FROM region)""",
    "upload_suggestions": """SELECT CASE WHEN id % 2 = 0 THEN 'sugerido_a' ELSE 'sugerido_b' END AS archivo, producto, sucursal_id,
        CASE WHEN id % 2 = 0 THEN round(total_sugerido_suc, 2) END AS total_sugerido_suc, CASE WHEN id % 2 = 0 THEN es_importado END AS es_importado,
        CASE WHEN id % 2 = 0 THEN CAST(lt_efectivo AS BIGINT) END AS lt_efectivo, CASE WHEN id % 2 = 0 THEN filtro1_final END AS filtro1_final,
        CASE WHEN id % 2 = 1 THEN clasificacion_abc END AS clasificacion_abc, CASE WHEN id % 2 = 1 THEN round(total_valor_sugerido_clp, 2) END AS total_valor_sugerido_clp FROM sgx""",
    "upload_sales": "SELECT producto, sucursal_id, mes, cantidad FROM vm",
    "border_report": """SELECT producto AS "Producto", sucursal AS "SUCURSAL", tipo_venta AS "TipoVenta", fecha AS "Fecha", cantidad AS "CantidadAjustada", fuente AS "Fuente" FROM ventas_b""",
    "tracking_reports": """SELECT producto AS "Producto", sucursal AS "SucursalID", razon AS "RazonSocial", CASE WHEN o = 2 THEN fecha_doc ELSE fecha_oc END AS "FechaOC", noc AS "NOC", origen AS "Origen", motivo AS "Motivo" FROM seg""",
    "mix_report": """SELECT g.producto AS "Producto", jefe AS "Producto_Master" FROM grupo g JOIN cabeza c ON c.master = g.master""",
    "sales_with_history": """SELECT producto AS "Producto", sucursal AS "SUCURSAL", tipo_venta AS "TipoVenta", fecha AS "Fecha", cantidad AS "CantidadAjustada", fuente AS "Fuente" FROM ventas_m""",
    "stock_by_branch_map": """SELECT producto AS "Producto", CASE WHEN s_nationkey < 20 THEN n_name ELSE 'DESCONOCIDO' END AS "SucursalID",
        CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS "Stock", ' -' AS "Costo" FROM lin WHERE l_partkey % 50 <> 0""",
    "border_extract": """SELECT strftime(o_orderdate, '%Y%m') AS "Periodo", docto AS "Documento", o_orderkey AS numero, CAST(o_orderdate AS DATE) AS fecha, CAST(p_partkey AS VARCHAR) AS producto,
        substr(p_name || ' de veinte letras', 1, 20) AS "Descripcion Producto", l_linenumber AS "Items", l_quantity AS cantidad, round(l_extendedprice, 2) AS total,
        CASE p_partkey % 3 WHEN 0 THEN 'REPUESTO' WHEN 1 THEN 'MO_TERC' ELSE 'MO_ST' END AS tipoproducto,
        CASE o_orderkey % 5 WHEN 0 THEN 'SERIE N' WHEN 1 THEN 'LIVIANOS' ELSE 'OTROS' END AS "SERIE UNIDAD",
        CASE p_partkey % 3 WHEN 0 THEN 'REPUESTOS' WHEN 1 THEN 'SERV. 3ro' ELSE 'OTROS PROD' END AS "TIPO PRODUCTO",
        CASE o_orderkey % 3 WHEN 0 THEN '02 LINDEROS' WHEN 1 THEN '01 LA FLORIDA' ELSE '99 Ver Sucursal' END AS "SUCURSAL",
        CASE WHEN docto = 'NOTA CREDITO ST' THEN -l_quantity ELSE l_quantity END AS "Costo Neto",
        round(CASE WHEN docto = 'NOTA CREDITO ST' THEN -l_extendedprice ELSE l_extendedprice END, 2) AS "Total Neta",
        CASE WHEN o_orderkey % 6 = 0 AND docto NOT IN ('CARGO INTERNO', 'CARGO GARANTIA') THEN 'Emision Pendiente' ELSE 'Emitido' END AS "Docto-Emitido"
        FROM docs JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE empresa = 'E07' AND docto <> 'OTRO' AND o_orderkey % 13 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "main_extract": """SELECT o_orderstatus AS "Empresa", o_orderdate AS "Fecha", o_orderkey AS "Numero", round(o_totalprice, 2) AS "Total" FROM orders
        WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-12-31 00:00:00'""",
    "national_extract": """SELECT producto AS "Producto", 'SUC' || lpad(CAST(plaza * 10 AS VARCHAR), 3, '0') AS "Sucursal", razon AS "RazonSocial", motivo AS "Motivo", fecha_oc AS "FechaOC", noc AS "NOC",
        cantidad AS "Cantidad", estado_oc AS "EstadoOC", estado_doc AS "EstadoDoc", fecha_doc AS "FechaDoc", fecha_pe AS "FechaPE" FROM seg WHERE o = 0""",
    "source_freshness": """SELECT fuente, max(d) AS entregado, any_value(lim) AS limite_dias, CAST(DATE '2024-02-05' - max(d) AS INTEGER) AS edad_dias, DATE '2024-02-05' - max(d) > any_value(lim) AS vencida
        FROM (SELECT CAST(ts AS DATE) AS d, CASE event_type WHEN 'click' THEN 'stock_bodegas' WHEN 'view' THEN 'seguimiento_frontera' WHEN 'error' THEN 'ventas_frontera' WHEN 'signup' THEN 'catalogo' END AS fuente,
                     CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 7 WHEN 'error' THEN 35 WHEN 'signup' THEN 120 END AS lim FROM events)
        WHERE fuente IS NOT NULL GROUP BY fuente""",
    "aggregate_catalogue": """SELECT producto, arg_min(p_name, p_partkey) FILTER (WHERE p_partkey % 3 <> 0) AS glosa, arg_min(p_type, p_partkey) FILTER (WHERE p_partkey % 4 <> 0) AS familia, 'UN' AS unidad,
        round(arg_min(p_retailprice, p_partkey), 2) AS costo, CAST(arg_min(p_size, p_partkey) FILTER (WHERE p_partkey % 6 <> 0) AS DOUBLE) AS stock_minimo,
        CAST(coalesce(sum(p_size * 2) FILTER (WHERE p_partkey % 5 <> 0), 0) AS DOUBLE) AS stock_total FROM pt WHERE p_partkey % 97 <> 0 GROUP BY producto""",
    "catalogue_counts": "SELECT count(*) AS leidas, count(*) FILTER (WHERE p_partkey % 97 = 0) AS saltadas, count(DISTINCT producto) FILTER (WHERE p_partkey % 97 <> 0) AS productos FROM pt",
    "load_postventa": "SELECT id, periodo, sucursal, datos FROM hoja",
    "postventa_meta": """SELECT 'filas' AS campo, NULL AS valor, count(*) AS filas FROM hoja UNION ALL SELECT 'periodo', periodo, count(*) FROM hoja WHERE periodo IS NOT NULL GROUP BY periodo
        UNION ALL SELECT 'sucursal', sucursal, count(*) FROM hoja WHERE sucursal IS NOT NULL GROUP BY sucursal""",
    "dim_product": """SELECT v.producto AS "Producto", m.c AS "Categoria", v.d AS "Descripcion",
        CASE WHEN r.numero IS NULL AND b.producto IS NOT NULL THEN 'CHEVROLET' ELSE CASE
          WHEN numero BETWEEN 10 AND 14 THEN 'NO REPRESENTADOS' WHEN numero IN (15,17,18,19,20,25) THEN 'FORD' WHEN numero IN (21,22,23,26,41) THEN 'LUBRICANTES'
          WHEN numero IN (24,28,29,32,37,38,39) THEN 'NO REPRESENTADOS' WHEN numero IN (33,40) THEN 'OTROS RUBROS' WHEN numero IN (34,35,36) THEN 'BMW' END END AS "FILTRO1_Final",
        'UNIDAD' AS "UnidadMedida"
        FROM (SELECT producto, min(p_name) AS d FROM raw_main GROUP BY producto) v
        LEFT JOIN (SELECT producto, min(p_type) AS c FROM pt WHERE p_partkey % 3 <> 0 GROUP BY producto) m ON m.producto = v.producto
        LEFT JOIN (SELECT producto, max('RUBRO ' || (p_size + 5)) AS f FROM pt WHERE p_partkey % 4 = 0 GROUP BY producto) f ON f.producto = v.producto
        LEFT JOIN (SELECT DISTINCT producto FROM raw_border) b ON b.producto = v.producto
        CROSS JOIN LATERAL (SELECT coalesce(CAST(substr(f.f, 7) AS INTEGER), CAST(regexp_extract(v.producto, '^(\\d+)\\s', 1) AS INTEGER)) AS numero) r""",
    "units_of_measure": """SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') || CASE WHEN p_partkey % 7 = 0 THEN '-TML' ELSE 'X' END AS producto,
        CASE WHEN p_partkey % 6 < 2 OR p_partkey % 7 = 0 THEN 'ML' WHEN p_partkey % 6 = 2 THEN 'LITRO' WHEN p_partkey % 6 = 3 THEN 'KG' WHEN p_partkey % 6 = 4 THEN 'GR' ELSE 'UNIDAD' END AS unidad,
        CASE WHEN p_partkey % 7 = 0 THEN 'GILDEMEISTER LIVIANOS' WHEN p_partkey % 2 = 0 THEN 'CHEVROLET' END AS familia FROM part""",
    "master_map": """SELECT g.producto AS "Producto", jefe AS "Producto_Master" FROM grupo g JOIN cabeza c ON c.master = g.master""",
    "imported": """SELECT DISTINCT producto AS "Producto" FROM seg WHERE o = 1""",
    "dim_product_upload": """SELECT producto, (arg_min({'a': descripcion, 'b': filtro1_final, 'c': unidad_medida, 'd': costo_unitario, 'e': proveedor, 'f': es_importado}, fila)).a AS descripcion,
        (arg_min({'b': filtro1_final}, fila)).b AS filtro1_final, (arg_min({'c': unidad_medida}, fila)).c AS unidad_medida, (arg_min({'d': costo_unitario}, fila)).d AS costo_unitario,
        (arg_min({'e': proveedor}, fila)).e AS proveedor, (arg_min({'f': es_importado}, fila)).f AS es_importado
        FROM (SELECT *, id * 100 + CAST(substr(sucursal_id, 8, 3) AS BIGINT) AS fila FROM sgx) GROUP BY producto""",
    "dim_branch_upload": """SELECT sucursal_id, (arg_min({'x': nombre_sucursal}, (id, producto))).x AS nombre, (arg_min({'x': abastece_cd}, (id, producto))).x AS abastece_desde_cd,
        CAST(substr(sucursal_id, 8, 3) AS INTEGER) AS prioridad_cd FROM sgx GROUP BY sucursal_id""",
    "filter_suggestions": """SELECT producto, sucursal_id, proveedor, clasificacion_abc, es_importado, pedir FROM ped WHERE clasificacion_abc IN ('A', 'B') AND tipo_origen = 'Nacional'
        AND proveedor ILIKE '%plier#00000000%' AND coalesce(es_importado, false) = false""",
    "search_suggestions": """SELECT producto, sucursal_id, pedir FROM vis WHERE nombre_sucursal IN ('Suc NATION_3', 'Suc NATION_9') AND (producto ILIKE '%RAND#17%' OR descripcion ILIKE '%RAND#17%'
        OR nombre_sucursal ILIKE '%RAND#17%' OR proveedor ILIKE '%RAND#17%' OR filtro1_final ILIKE '%RAND#17%' OR tipo_origen ILIKE '%RAND#17%' OR clasificacion_abc ILIKE '%RAND#17%' OR abastece_cd ILIKE '%RAND#17%')""",
    "views_sucursales": f"SELECT producto, sucursal_id FROM ped WHERE sucursal_id <> 'NATION_0' AND NOT {VIA_CD}",
    "views_cd": "SELECT producto, sucursal_id FROM ped WHERE sucursal_id = 'NATION_0'",
    "views_distribucion": f"SELECT producto, sucursal_id FROM vis WHERE sucursal_id <> 'NATION_0' AND {VIA_CD} AND (sugerido_traslado > 0 OR total_sugerido_suc > 0)",
    "suggestion_page": f"SELECT producto, sucursal_id, costo_unitario FROM vis {page('costo_unitario ASC NULLS LAST, producto, sucursal_id', 80, 40)}",
    "suggestion_page_seek": """SELECT producto, sucursal_id, costo_unitario FROM vis WHERE costo_unitario > 980 OR costo_unitario IS NULL
        OR (costo_unitario = 980 AND (producto, sucursal_id) > ('25 Brand#13', 'NATION_7')) ORDER BY costo_unitario ASC NULLS LAST, producto, sucursal_id LIMIT 40""",
    "suggestion_total": "SELECT count(*) AS total FROM ped",
    "list_search_total": """WITH pag AS (SELECT * FROM vis WHERE producto ILIKE '%x1%' OR descripcion ILIKE '%x1%' OR nombre_sucursal ILIKE '%x1%' OR proveedor ILIKE '%x1%' OR filtro1_final ILIKE '%x1%'
            OR tipo_origen ILIKE '%x1%' OR clasificacion_abc ILIKE '%x1%' OR abastece_cd ILIKE '%x1%'),
          mq AS (SELECT * FROM act WHERE u > 0 AND producto ILIKE '%x1%'),
          visto AS (SELECT * FROM pag ORDER BY total_sugerido_suc DESC NULLS LAST, producto, sucursal_id LIMIT 30)
        SELECT (SELECT count(*) FROM pag) + (SELECT count(*) FROM mq m WHERE NOT EXISTS (SELECT 1 FROM visto v WHERE v.producto = m.producto AND v.sucursal_id = m.sucursal_id))
             + (SELECT count(*) FROM ctg WHERE (producto ILIKE '%x1%' OR glosa ILIKE '%x1%') AND producto NOT IN (SELECT producto FROM sgx) AND producto NOT IN (SELECT producto FROM mq)) AS total""",
    "published": """SELECT CAST('0x' || substr(md5("Producto" || '|' || "SucursalID"), 1, 15) AS BIGINT) AS id, "Producto" AS producto, "SucursalID" AS sucursal_id, total_sugerido_suc,
        CAST(round_even("LT Efectivo", 0) AS BIGINT) AS lt_efectivo, "Pedir" AS pedir FROM plan""",
    "catalogue_total": "SELECT count(*) AS total FROM ctg WHERE (producto ILIKE '%red%' OR glosa ILIKE '%red%') AND procedencia = 'NACIONAL' AND stock_total > 0",
    "recurring_events": """SELECT 'recurrente_aplicada' AS accion, c.id AS entidad_id, producto, sucursal_id, unidades, 'Ejecucion automatica: ' || coalesce(n, 0) || ' instancia(s) creada(s)' AS detalle
        FROM corren c LEFT JOIN (SELECT regla, count(*) AS n FROM nuevas WHERE unidades > 0 GROUP BY regla) n ON n.regla = c.id""",
    "expired_event": f"""SELECT 'expiradas_archivadas' AS accion, 'sugerencia_manual' AS entidad, 'Vencimiento automatico: ' || count(*) || ' sugerencia(s) manual(es) archivada(s)' AS detalle
        FROM man WHERE NOT archivada AND expira_en <= {NOW} HAVING count(*) > 0""",
    "audit_total": "SELECT count(*) AS total FROM aud WHERE accion NOT IN ('error', 'click')",
    "manual_active": "SELECT producto, sucursal_id, CAST(u AS BIGINT) AS manual FROM act WHERE u > 0",
    "list_with_manual": "SELECT producto, sucursal_id, total_sugerido_suc, sugerido_compra_neto, round(total_valor_sugerido_clp, 2) AS total_valor_sugerido_clp, pedir, pedir_flag FROM conman",
    "list_search": f"""WITH pag AS (SELECT * FROM vis WHERE producto ILIKE '%x1%' OR descripcion ILIKE '%x1%' OR nombre_sucursal ILIKE '%x1%' OR proveedor ILIKE '%x1%' OR filtro1_final ILIKE '%x1%'
            OR tipo_origen ILIKE '%x1%' OR clasificacion_abc ILIKE '%x1%' OR abastece_cd ILIKE '%x1%'),
          mq AS (SELECT * FROM act WHERE u > 0 AND producto ILIKE '%x1%'),
          c200 AS (SELECT * FROM ctg WHERE (producto ILIKE '%x1%' OR glosa ILIKE '%x1%') AND producto NOT IN (SELECT producto FROM sgx))
        SELECT 'manual' AS origen, m.producto, m.sucursal_id, glosa AS descripcion, round(costo, 2) AS costo_unitario, NULL AS stock_activo_suc, CAST(u AS DOUBLE) AS total_sugerido_suc, CAST(u AS DOUBLE) AS sugerido_compra_neto,
               round(u * costo, 2) AS total_valor_sugerido_clp, 'Si' AS pedir, reemplazo AS reemplazos
        FROM mq m LEFT JOIN ctg c ON c.producto = m.producto WHERE (SELECT count(*) FROM pag) = 0
        UNION ALL
        SELECT 'catalogo', c.producto, NULL, glosa, round(costo, 2), s.t, NULL, NULL, NULL, NULL, reemplazo FROM c200 c
        LEFT JOIN (SELECT producto, sum(stock) AS t FROM stu GROUP BY producto) s ON s.producto = c.producto WHERE c.producto NOT IN (SELECT producto FROM mq)""",
    "list_by_ids": f"""SELECT t.pos, c.id, c.producto, c.sucursal_id, c.total_sugerido_suc, CASE WHEN {STOPPED} THEN 'No' ELSE pedir END AS pedir, coalesce(nullif(reemplazos, ''), reemplazo) AS reemplazos
        FROM (VALUES (0, 7), (2, 100), (3, 59), (4, 7), (5, 1234), (6, 60), (7, 88)) t(pos, id) JOIN conman c ON c.id = t.id LEFT JOIN ctg ON ctg.producto = c.producto
        LEFT JOIN {SOLD_BEFORE.format('202312')} x ON x.producto = c.producto AND x.sucursal_id = c.sucursal_id""",
    "enrich_replacements": "SELECT s.producto, sucursal_id, coalesce(nullif(reemplazos, ''), reemplazo) AS reemplazos FROM sgx s LEFT JOIN ctg c ON c.producto = s.producto",
    "rule_stock_without_sale": f"""SELECT s.producto, s.sucursal_id, CASE WHEN {STOPPED} THEN 'No' ELSE pedir END AS pedir, CASE WHEN {STOPPED} THEN 'No' ELSE pedir_flag END AS pedir_flag
        FROM sgx s LEFT JOIN {SOLD_BEFORE.format('200107')} x ON x.producto = s.producto AND x.sucursal_id = s.sucursal_id""",
    "kpis": f"SELECT {KPIS} FROM ped",
    "summary_view": f"SELECT {KPIS} FROM ped WHERE sucursal_id <> 'NATION_0' AND NOT {VIA_CD} AND proveedor ILIKE '%plier#00000001%'",
    "grouped_branch": grouped("nombre_sucursal"),
    "grouped_brand": grouped("filtro1_final"),
    "grouped_supplier": grouped("proveedor"),
    "ranking": grouped("filtro1_final", "(SELECT * FROM ped WHERE sucursal_id = 'NATION_0')", 7),
    "units_from_days": "SELECT producto, sucursal_id, greatest(1, CAST(ceil(demanda_diaria * 45) AS BIGINT)) AS unidades FROM sgx WHERE demanda_diaria > 0",
    "detail": "SELECT producto, sucursal_id, descripcion, total_sugerido_suc, proveedor FROM sgx WHERE producto = '11 Brand#2' AND sucursal_id = 'NATION_9'",
    "sales_12m": "SELECT * FROM s12",
    "sales_12m_totals": """SELECT producto, sum(cantidad_general) AS total_general, sum(cantidad_sucursal) AS total_sucursal, round(avg(cantidad_general), 4) AS promedio_general,
        round(avg(cantidad_sucursal), 4) AS promedio_sucursal FROM s12 GROUP BY producto""",
    "coverage": """SELECT producto, sucursal_id, round(opt, 4) AS stock_optimo, CASE WHEN opt > 0 THEN round(least(100.0, coalesce(stock_activo_suc, 0) / opt * 100), 4) ELSE 0.0 END AS cobertura_pct,
        coalesce(stock_activo_suc, 0) + coalesce(stock_en_transito_suc, 0) AS disponible,
        CASE WHEN coalesce(sugerido_traslado, 0) + coalesce(sugerido_compra_neto, 0) > 0 THEN round(coalesce(sugerido_traslado, 0) / (coalesce(sugerido_traslado, 0) + coalesce(sugerido_compra_neto, 0)), 4) END AS parte_traslado
        FROM (SELECT *, coalesce(demanda_diaria, 0) * (5 + lt_efectivo) + stock_seguridad AS opt FROM sgx)""",
    "cart_lines": "SELECT *, round(cantidad * coalesce(costo_unitario, 0), 2) AS subtotal_clp FROM carro",
    "cart_totals": "SELECT proveedor, count(*) AS n_productos, sum(cantidad) AS total_unidades, round(sum(cantidad * coalesce(costo_unitario, 0)), 2) AS total_clp FROM carro GROUP BY proveedor",
    "cart_grand_totals": "SELECT count(DISTINCT proveedor) AS total_proveedores, round(sum(cantidad * coalesce(costo_unitario, 0)), 2) AS total_clp, sum(cantidad) AS total_unidades FROM carro_a",
    "cart_report": """SELECT 0 AS nivel, proveedor, producto, descripcion, clasificacion_abc, costo_unitario, cantidad, round(cantidad * coalesce(costo_unitario, 0), 2) AS subtotal_clp, 1 AS n_productos FROM carro
        UNION ALL SELECT 1, proveedor, NULL, NULL, NULL, NULL, sum(cantidad), round(sum(cantidad * coalesce(costo_unitario, 0)), 2), count(*) FROM carro GROUP BY proveedor
        UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL, coalesce(sum(cantidad), 0), round(coalesce(sum(cantidad * coalesce(costo_unitario, 0)), 0), 2), count(*) FROM carro""",
    "purchase_orders": """SELECT proveedor, 0 AS renglon, producto AS "Producto", descripcion AS "Descripcion", clasificacion_abc AS "ABC", cantidad AS "Cantidad", costo_unitario AS "Costo Unitario",
        round(cantidad * coalesce(costo_unitario, 0), 2) AS "Subtotal" FROM carro
        UNION ALL SELECT proveedor, 1, 'TOTAL', NULL, NULL, NULL, NULL, round(sum(cantidad * coalesce(costo_unitario, 0)), 2) FROM carro GROUP BY proveedor""",
    "export_columns": """SELECT producto AS "Producto", sucursal_id AS "ID Sucursal", pedir AS "Pedir", lt_efectivo AS "LT Efectivo" FROM sgx""",
    "suggestion_with_manual": """SELECT s.producto, s.sucursal_id, CAST(coalesce(u, 0) AS BIGINT) AS ajuste_manual_vigente, coalesce(total_sugerido_suc, 0) + coalesce(u, 0) AS total_sugerido_con_manual
        FROM sgx s LEFT JOIN act a ON a.producto = s.producto AND a.sucursal_id = s.sucursal_id""",
    "supplier_list": "SELECT DISTINCT proveedor FROM sgx WHERE proveedor IS NOT NULL",
    "catalogue_list": """SELECT c.producto, glosa, costo, coalesce(t, stock_total) AS stock_total FROM (SELECT * FROM ctg WHERE (producto ILIKE '%red%' OR glosa ILIKE '%red%') AND procedencia = 'NACIONAL' AND stock_total > 0
          ORDER BY costo DESC NULLS LAST, producto LIMIT 25 OFFSET 25) c LEFT JOIN (SELECT producto, sum(stock) AS t FROM stu GROUP BY producto) s ON s.producto = c.producto""",
    "catalogue_list_seek": """SELECT c.producto, glosa, costo, coalesce(t, stock_total) AS stock_total FROM (SELECT * FROM ctg WHERE (producto ILIKE '%red%' OR glosa ILIKE '%red%') AND procedencia = 'NACIONAL' AND stock_total > 0
          AND (costo < 990 OR costo IS NULL OR (costo = 990 AND producto > '25 Brand#13')) ORDER BY costo DESC NULLS LAST, producto LIMIT 25) c LEFT JOIN (SELECT producto, sum(stock) AS t FROM stu GROUP BY producto) s ON s.producto = c.producto""",
    "catalogue_detail": """SELECT c.producto, coalesce(t, stock_total) AS stock_total, coalesce(p, '') AS partes FROM ctg c LEFT JOIN (
          SELECT producto, sum(stock) AS t, string_agg(bodega || '|' || sucursal_id || '|' || origen || '|' || CAST(stock AS INTEGER), ';' ORDER BY stock DESC, bodega, sucursal_id, origen) AS p FROM stu GROUP BY producto) s
        ON s.producto = c.producto WHERE c.producto = '11 Brand#2'""",
    "filter_options": """SELECT DISTINCT 'familia' AS campo, familia AS valor FROM ctg UNION SELECT 'procedencia', procedencia FROM ctg UNION SELECT 'categoria', categoria FROM ctg""",
    "stock_totals": "SELECT producto, sum(stock) AS stock_total FROM stu GROUP BY producto",
    "stock_of_product": "SELECT bodega, sucursal_id, stock, origen FROM stu WHERE producto = '11 Brand#2'",
    "product_card": """SELECT c.producto, glosa AS descripcion, familia, procedencia, costo AS costo_unitario, stock_total AS stock_total_catalogo, coalesce(n, 0) AS en_sugerido_sucursales,
        coalesce(t, 0.0::DOUBLE) AS total_sugerido_todas_sucursales FROM ctg c LEFT JOIN (SELECT producto, count(*) AS n, sum(total_sugerido_suc) AS t FROM sgx GROUP BY producto) s ON s.producto = c.producto""",
    "product_search": f"""WITH d AS (SELECT * FROM {DIMP} WHERE {MATCH7.format('descripcion')} ORDER BY producto LIMIT 60),
          e AS (SELECT producto, glosa AS descripcion, unidad AS unidad_medida FROM ctg WHERE {MATCH7.format('glosa')} AND producto NOT IN (SELECT producto FROM d) ORDER BY producto LIMIT 60)
        SELECT * FROM (SELECT *, 0 AS orden FROM d UNION ALL SELECT *, 1 FROM e) ORDER BY orden, producto LIMIT 60""",
    "product_search_total": f"""WITH d AS (SELECT * FROM {DIMP} WHERE {MATCH7.format('descripcion')}), h AS (SELECT * FROM d ORDER BY producto LIMIT 60)
        SELECT (SELECT count(*) FROM d) + CASE WHEN (SELECT count(*) FROM h) < 60 THEN (SELECT count(*) FROM ctg WHERE {MATCH7.format('glosa')} AND producto NOT IN (SELECT producto FROM h)) ELSE 0 END AS total""",
    "catalogue_search": "SELECT producto, glosa AS descripcion, familia, costo FROM ctg WHERE producto ILIKE '%blue g%' OR glosa ILIKE '%blue g%' ORDER BY producto LIMIT 10",
    "list_branches": """SELECT sucursal_id, (arg_min({'x': nombre_sucursal}, (id, producto))).x AS nombre, (arg_min({'x': abastece_cd}, (id, producto))).x AS abastece_desde_cd,
        CAST(substr(sucursal_id, 8, 3) AS INTEGER) AS prioridad_cd FROM sgx GROUP BY sucursal_id""",
    "postventa_summary": "SELECT periodo, sucursal, round(total_clp, 2) AS total_clp, total_unidades, n_lineas FROM resumen",
    "postventa_summary_stored": "SELECT periodo, sucursal, round(total_clp, 2) AS total_clp, total_unidades, n_lineas FROM resumen",
    "periods": "SELECT DISTINCT periodo FROM resumen",
    "sales_kpis": """SELECT periodo, round(clp, 2) AS clp, unidades, n_lineas, pa AS periodo_anterior, round(ca, 2) AS clp_anterior, ua AS unidades_anterior, la AS n_lineas_anterior,
        round((clp - ca) / ca * 100, 2) AS var_clp_pct, round((unidades - ua) / ua * 100, 2) AS var_unidades_pct
        FROM (SELECT *, lag(periodo) OVER w AS pa, lag(clp) OVER w AS ca, lag(unidades) OVER w AS ua, lag(n_lineas) OVER w AS la FROM porper WINDOW w AS (ORDER BY periodo)) ORDER BY periodo DESC LIMIT 1""",
    "monthly_series": "SELECT periodo, round(clp, 2) AS clp, unidades FROM porper ORDER BY periodo DESC LIMIT 12",
    "by_branch": """SELECT coalesce(sucursal, '(sin sucursal)') AS sucursal, round(sum(total_clp), 2) AS clp, sum(total_unidades) AS unidades, CAST(sum(n_lineas) AS BIGINT) AS n_lineas FROM resumen WHERE periodo = '200003' GROUP BY ALL""",
    "by_branch_newest": """SELECT coalesce(sucursal, '(sin sucursal)') AS sucursal, round(sum(total_clp), 2) AS clp, sum(total_unidades) AS unidades, CAST(sum(n_lineas) AS BIGINT) AS n_lineas FROM resumen
        WHERE periodo = (SELECT max(periodo) FROM resumen) GROUP BY 1""",
    "sales_lines": f"""SELECT id, c[1] AS "Periodo", c[2] AS "Local", c[3] AS "SUCURSAL", c[4] AS "Producto", c[5] AS "Fecha", c[6] AS "Cantidad", c[7] AS "Total", c[8] AS "Total Neta"
        FROM lineas {page('periodo DESC, id DESC', 50, 50)}""",
    "sales_count": "SELECT count(*) AS filas FROM lineas",
    "sales_export": """SELECT c[1] AS "Periodo", c[2] AS "Local", c[3] AS "SUCURSAL", c[4] AS "Producto", c[5] AS "Fecha", CAST(cant AS DOUBLE) AS "Cantidad", round(o_totalprice, 2) AS "Total",
        try_cast(replace(c[8], ',', '.') AS DOUBLE) AS "Total Neta" FROM hoja WHERE periodo >= '200001' AND sucursal = 'NATION_4'""",
    "last_periods_extract": "SELECT mes, producto, sucursal_id, sum(cantidad) AS cantidad FROM vm WHERE mes IN (SELECT DISTINCT mes FROM vm ORDER BY mes DESC LIMIT 12) GROUP BY ALL",
    "code_match": "SELECT codigo, valor, tipo FROM mejor",
    "code_match_counts": """SELECT count(*) AS total, count(*) FILTER (WHERE t = 'exacto') AS exactos, count(*) FILTER (WHERE t IN ('prefijo', 'contiene')) AS expandidos,
        count(*) FILTER (WHERE t IS NULL) AS sin_match FROM (SELECT codigo, min(tipo) AS t FROM mejor GROUP BY codigo)""",
    "column_filter": "SELECT producto, sucursal_id, proveedor FROM sgx WHERE (proveedor IS NULL OR proveedor = 'Supplier#000000007') AND contains(lower(producto), 'brand#2')",
    "distinct_values": "SELECT valor FROM valores",
    "manual_batches": "SELECT lote_id, count(*) AS entradas, CAST(sum(unidades) AS BIGINT) AS unidades, max(creado_en) AS creado_en FROM man WHERE lote_id IS NOT NULL GROUP BY lote_id",
    "single_entries": "SELECT id, producto, sucursal_id, creado_en FROM man WHERE lote_id IS NULL",
    "shadow_compare": "SELECT * FROM sombra",
    "shadow_summary": """SELECT count(*) FILTER (WHERE estado IN ('igual', 'distinta')) AS comunes, count(*) FILTER (WHERE estado = 'solo_motor') AS solo_motor, count(*) FILTER (WHERE estado = 'solo_oficial') AS solo_oficial,
        round(count(*) FILTER (WHERE estado = 'igual') * 100.0 / count(*) FILTER (WHERE estado IN ('igual', 'distinta')), 2) AS paridad_pct FROM sombra""",
    "shadow_worst": "SELECT * FROM sombra WHERE estado = 'distinta' ORDER BY diferencia DESC, producto, sucursal_id LIMIT 10",
    "parity_mismatch": """SELECT a.producto, a.sucursal_id, b.total_sugerido_suc AS motor_total_sugerido_suc, a.total_sugerido_suc AS golden_total_sugerido_suc FROM v1 a LEFT JOIN v2 b ON a.k = b.k
        WHERE abs(coalesce(b.total_sugerido_suc, 0) - coalesce(a.total_sugerido_suc, 0)) > 0.5""",
    "parity_text": "SELECT a.producto, a.sucursal_id FROM v1 a LEFT JOIN v2 b ON a.k = b.k WHERE a.pedir IS DISTINCT FROM b.pedir",
    "change_log": """SELECT k, cambio, CASE WHEN cambio = 'modificada' THEN detalle END AS detalle FROM (
          SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'agregada' WHEN b.k IS NULL THEN 'eliminada' ELSE 'modificada' END AS cambio,
                 concat_ws('; ', CASE WHEN a.total_sugerido_suc IS DISTINCT FROM b.total_sugerido_suc THEN 'total_sugerido_suc: ' || coalesce(CAST(CAST(a.total_sugerido_suc AS BIGINT) AS VARCHAR), 'None') || ' -> ' || coalesce(CAST(CAST(b.total_sugerido_suc AS BIGINT) AS VARCHAR), 'None') END,
                           CASE WHEN a.pedir IS DISTINCT FROM b.pedir THEN 'pedir: ' || coalesce(a.pedir, 'None') || ' -> ' || coalesce(b.pedir, 'None') END) AS detalle
          FROM v1 a FULL JOIN v2 b ON a.k = b.k) WHERE cambio <> 'modificada' OR detalle <> ''""",
    "expire_at": """SELECT o_orderkey, timezone('UTC', timezone('America/Santiago', CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP))) AS expira_en,
        CAST(o_orderdate AS DATE) >= DATE '1999-01-01' AS aceptada FROM orders""",
    "bulk_manual": f"""SELECT 'LOTE:' || producto || ':' || sucursal_id AS id, producto, sucursal_id, greatest(1, CAST(ceil(demanda_diaria * 30) AS BIGINT)) AS unidades, 'LOTE' AS lote_id, {NOW} AS creado_en, false AS archivada
        FROM ped WHERE clasificacion_abc = 'B' AND sucursal_id <> 'NATION_0' AND NOT {VIA_CD} AND demanda_diaria > 0""",
    "bulk_counts": f"""SELECT count(*) FILTER (WHERE coalesce(demanda_diaria > 0, false)) AS creadas, count(*) FILTER (WHERE NOT coalesce(demanda_diaria > 0, false)) AS omitidas
        FROM ped WHERE clasificacion_abc = 'B' AND sucursal_id <> 'NATION_0' AND NOT {VIA_CD}""",
    "drop_batch": "SELECT id, lote_id, recurrente_id FROM man WHERE NOT (coalesce(lote_id = 'L3', false) AND recurrente_id IS NULL)",
    "list_manual": "SELECT id, producto, sucursal_id, unidades FROM man WHERE sucursal_id = 'NATION_4' AND NOT archivada AND recurrente_id IS NULL",
    "active_entries": f"SELECT id, unidades, creado_por FROM man WHERE {ACTIVE} AND sucursal_id = 'NATION_5' ",
    "active_rules": "SELECT id, modo, unidades, cada AS cada_dias, proxima AS proxima_ejecucion FROM reglas WHERE activa AND sucursal_id = 'NATION_5'",
    "recurring_rules": """SELECT id, nueva AS proxima_ejecucion, CASE WHEN turno AND pasada THEN false WHEN turno AND coalesce(nueva > fin, false) THEN false ELSE activa END AS activa,
        CASE WHEN turno AND NOT pasada THEN DATE '2024-01-20' END AS ultima_ejecucion FROM (
          SELECT *, CASE WHEN turno AND NOT pasada THEN proxima + CAST(cada * (floor((DATE '2024-01-20' - proxima) / cada) + 1) AS INTEGER) ELSE proxima END AS nueva FROM avance)""",
    "recurring_step": """SELECT id, producto, sucursal_id, unidades, archivada OR coalesce(recurrente_id IN (SELECT id FROM corren), false) AS archivada, recurrente_id, creado_por FROM man
        UNION ALL SELECT id, producto, sucursal_id, unidades, false, regla, 'recurrente' FROM nuevas WHERE unidades > 0""",
    "recurring_counts": "SELECT (SELECT count(*) FROM corren) AS recurrencias_procesadas, (SELECT count(*) FROM nuevas WHERE unidades > 0) AS sugerencias_creadas",
    "expire_manual": f"SELECT id, archivada OR coalesce(expira_en <= {NOW}, false) AS archivada FROM man",
    "count_expired": f"SELECT count(*) FILTER (WHERE NOT archivada AND expira_en <= {NOW}) AS archivadas FROM man",
    "audit_page": f"SELECT * FROM aud WHERE accion NOT IN ('error', 'click') {page('creado_en DESC, id DESC', 100, 100)}",
    "audit_page_seek": """SELECT * FROM aud WHERE accion NOT IN ('error', 'click') AND (creado_en < TIMESTAMP '2024-01-12 06:00:00' OR (creado_en = TIMESTAMP '2024-01-12 06:00:00' AND id < 100))
        ORDER BY creado_en DESC, id DESC LIMIT 100""",
    "last_event": "SELECT creado_en, detalle FROM aud WHERE accion = 'signup' ORDER BY creado_en DESC, id DESC LIMIT 1",
    "unread_notifications": """SELECT id, creado_en, false AS leida FROM leen WHERE NOT list_contains(lectores, 'ana') ORDER BY creado_en DESC, id DESC LIMIT 20""",
    "unread_count": "SELECT count(*) FILTER (WHERE NOT list_contains(lectores, 'ana')) AS no_leidas FROM leen",
    "mark_read": """SELECT id, CASE WHEN list_contains(lectores, 'beto') THEN vistas_por ELSE array_to_string(list_sort(list_append(lectores, 'beto')), ',') END AS vistas_por FROM leen""",
    "fixture_subset": """SELECT producto AS "Producto" FROM elegidos UNION SELECT producto FROM mapeo WHERE master IN (SELECT producto FROM elegidos)""",
    "load_counts": "SELECT count(*) FILTER (WHERE sucursal_id <> 'NATION_3') AS cargadas, count(*) FILTER (WHERE sucursal_id = 'NATION_3') AS omitidas FROM sgx",
    "load_warnings": """SELECT 0 AS filas_omitidas, count(*) FILTER (WHERE total_sugerido_suc > 0) AS con_sugerido, count(*) FILTER (WHERE total_sugerido_suc > 0 AND proveedor IS NULL) AS sin_proveedor,
        CAST(round_even(count(*) FILTER (WHERE total_sugerido_suc > 0 AND proveedor IS NULL) * 100.0 / count(*) FILTER (WHERE total_sugerido_suc > 0), 0) AS DOUBLE) AS sin_proveedor_pct FROM sgx""",
    "anomalous_products": "SELECT DISTINCT producto FROM sgx WHERE total_sugerido_suc * 100 > 10000 ORDER BY producto LIMIT 10",
    "replace_stock": "SELECT producto, bodega, sucursal_id, origen, CASE WHEN stock < 40 THEN stock ELSE 0.0 END AS stock FROM stu",
    "replace_monthly_sales": "SELECT producto, sucursal_id, mes, cantidad FROM vm WHERE mes <> '200105'",
    "received_check": "SELECT count(*) AS recibidas, count(*) FILTER (WHERE stock_total > 0) AS cargadas, count(*) <> count(*) FILTER (WHERE stock_total > 0) AS difiere, count(*) >= 2000 AS en_limite FROM ctg",
}


def oracles() -> dict[str, str]:
    made = {}
    for name, body in BODIES.items():
        if body.lstrip().startswith("WITH "):
            shared = statement(CTES, body)
            made[name] = _merge(shared, body)
        else:
            made[name] = statement(CTES, body)
    return made


def _merge(shared: str, body: str) -> str:
    """One WITH clause for a body that brings table expressions of its own."""
    own = body.lstrip().removeprefix("WITH ")
    head = shared[: -len(body.strip())].rstrip()
    return f"{head}, {own}" if head else body
