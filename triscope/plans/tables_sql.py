"""SQL of the views that several queries start from."""

FILES_NOW = """f AS (SELECT * FROM (SELECT *, nullif(upper(trim(file_id)), '') AS fid, nullif(upper(trim(object_id)), '') AS oid,
  row_number() OVER (PARTITION BY upper(trim(file_id)) ORDER BY received_at DESC NULLS LAST, file_id DESC) AS rn FROM files) WHERE rn = 1 AND fid IS NOT NULL)"""

CHECKS_NOW = """c AS (SELECT * FROM (SELECT *, nullif(upper(trim(object_id)), '') AS oid,
  row_number() OVER (PARTITION BY check_id ORDER BY received_at DESC NULLS LAST, coalesce(object_id, '') DESC) AS rn FROM checks) WHERE rn = 1)"""

EVIDENCE = CHECKS_NOW + """, e AS (SELECT check_id, oid, i - 1 AS ord, v.stage AS stage, nullif(upper(trim(v.file_id)), '') AS fid, v.pdf_page_number AS page, v.bbox_norm AS box, v.fragment AS fragment
  FROM (SELECT check_id, oid, unnest(evidence) AS v, generate_subscripts(evidence, 1) AS i FROM c) WHERE v IS NOT NULL)"""
