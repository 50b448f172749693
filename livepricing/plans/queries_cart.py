"""Registered cart and category queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cart as C
from ..operators import hierarchy as H
from ..session import stage_table
from .oracle import cart_sql, hierarchy_sql, with_model
from .registry import model_for, on_model, register

EXPANDED = "1, 2,3 ,x,,105, 110"


def lines_of(m):
    # built per query: each registered query computes its own cart lines
    return C.cart_lines(m, copies=C.stored_copies(m))


@register("cart_lines", cart_sql("FROM basket_priced"), ids="V7 J6 A7 A16 S7 S8")
@on_model
def cart_lines(m):
    return lines_of(m)


@register("cart_total_exact",
          cart_sql("SELECT CAST(COALESCE(ROUND(SUM(CAST(price AS DECIMAL(20,10))), 2), 0) AS DOUBLE) "
                   "AS cart_total FROM basket_priced"),
          ids="A10 P12 F2")
@on_model
def cart_total_exact(m):
    return C.cart_total(lines_of(m))


@register("cart_items_sorted", cart_sql("FROM basket_priced ORDER BY price DESC"), ids="O1")
@on_model
def cart_items_sorted(m):
    return C.cart_items_sorted(lines_of(m))


@register("category_totals",
          hierarchy_sql("SELECT category_id, parent_id, has_subcategory, category_name, "
                        "CAST(total AS DOUBLE) AS total, item_count FROM shown"),
          ids="V8 R1 R2 R3 R4 U1 J7 J8 J9 A7 A8 A9 P9 P11")
@on_model
def category_totals(m):
    return H.category_totals(m, lines_of(m))


@register("has_subcategory",
          with_model(body="""
SELECT category_id, category_id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) AS has_subcategory
FROM categories"""),
          ids="R3 J7 A8")
@on_model
def has_subcategory(m):
    return H.has_subcategory(m.categories)


@register("ancestor_closure",
          with_model(body="""
SELECT * FROM (
  WITH RECURSIVE anc(category_id, ancestor_id, depth) AS (
    SELECT category_id, category_id, 0 FROM categories
    UNION ALL
    SELECT a.category_id, c.parent_id, a.depth + 1
    FROM anc a JOIN categories c ON a.ancestor_id = c.category_id
    WHERE c.parent_id IS NOT NULL)
  SELECT category_id, ancestor_id, CAST(depth AS INTEGER) AS depth FROM anc) t"""),
          ids="R1")
@on_model
def ancestor_closure(m):
    return H.ancestor_pairs(m.categories).select("category_id", "ancestor_id", "depth")


@register("other_rows",
          hierarchy_sql("SELECT category_id, parent_id, has_subcategory, category_name, "
                        "CAST(total AS DOUBLE) AS total, item_count FROM shown "
                        "WHERE category_name = 'Other' AND category_id >= 1000 AND has_subcategory = false"),
          ids="R4 P11")
@on_model
def other_rows(m):
    t = H.category_totals(m, lines_of(m))
    return t.where((F.col("category_name") == H.OTHER_NAME) & (F.col("category_id") >= H.OTHER_ID_OFFSET)
                   & ~F.col("has_subcategory"))


_DRILL_IDS = ",".join(str(i) for i in H.parse_expanded(EXPANDED))


@register("cart_drilldown",
          hierarchy_sql(f"""
SELECT category_id, parent_id, has_subcategory, category_name, item_count,
       CAST(round(total, 2) AS DOUBLE) AS subtotal,
       CAST(round(sum(total) FILTER (WHERE parent_id IS NULL) OVER (), 2) AS DOUBLE) AS categories_total
FROM shown WHERE parent_id IS NULL OR list_contains([{_DRILL_IDS}], parent_id)"""),
          ids="R5 P10 A11 O2 F13 S12 S22")
@on_model
def cart_drilldown(m):
    return H.drilldown(m, lines_of(m), EXPANDED)


@register("category_list",
          with_model(body="SELECT DISTINCT category_id, category_name FROM categories ORDER BY category_name"),
          ids="V11 A14 U2 O5")
@on_model
def category_list(m):
    return H.category_list(m)


@register("subtotals_by_name",
          hierarchy_sql("SELECT category_name, item_count, CAST(total AS DOUBLE) AS subtotal "
                        "FROM shown ORDER BY category_name"),
          ids="V12 O5")
@on_model
def subtotals_by_name(m):
    return H.subtotals_by_name(m, lines_of(m))


@register("cart_message",
          cart_sql("""
SELECT COUNT(*) AS item_count,
       CAST(COALESCE(ROUND(SUM(CAST(price AS DECIMAL(20,10))), 2), 0) AS DOUBLE) AS total,
       replace(replace('With the current items in your cart ($count$ items totaling $$total$),',
                       '$count$', CAST(COUNT(*) AS VARCHAR)), '$total$',
               printf('%.2f', CAST(COALESCE(ROUND(SUM(CAST(price AS DECIMAL(20,10))), 2), 0) AS DOUBLE)))
         AS message
FROM basket_priced"""),
          ids="P17 A15 F14")
@on_model
def cart_message(m):
    return C.cart_message(lines_of(m))


#: What the objects of the document hold, all sections together, as JSON text is read back.
DOCUMENT_FIELDS = ("product_id bigint, product_name string, category_id bigint, category_name string, price double, available_stock bigint, "
                   "parent_id bigint, has_subcategory boolean, item_count bigint, subtotal double, cart_total double, categories_total double")


@register("cart_document", hierarchy_sql(f"""
SELECT 'cart_item' AS section, product_id, product_name, category_id, category_name, CAST(price AS DOUBLE) AS price,
       CAST(available_stock AS BIGINT) AS available_stock, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BOOLEAN) AS has_subcategory,
       CAST(NULL AS BIGINT) AS item_count, CAST(NULL AS DOUBLE) AS subtotal, CAST(NULL AS DOUBLE) AS cart_total,
       CAST(NULL AS DOUBLE) AS categories_total
FROM basket_priced
UNION ALL
SELECT 'category_subtotal', NULL, NULL, category_id, category_name, NULL, NULL, parent_id, has_subcategory, item_count,
       CAST(round(total, 2) AS DOUBLE), NULL, categories_total
FROM (SELECT *, CAST(round(sum(total) FILTER (WHERE parent_id IS NULL) OVER (), 2) AS DOUBLE) AS categories_total FROM shown) s
WHERE parent_id IS NULL OR list_contains([{_DRILL_IDS}], parent_id)
UNION ALL
SELECT 'totals', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       (SELECT CAST(COALESCE(ROUND(SUM(CAST(price AS DECIMAL(20,10))), 2), 0) AS DOUBLE) FROM basket_priced),
       (SELECT CAST(coalesce(round(sum(total), 2), 0) AS DOUBLE) FROM shown WHERE parent_id IS NULL)"""), ids="V9 IO16")
def cart_document(spark, sf_dir):
    """The document's objects, read back from their JSON text."""
    m = model_for(spark, sf_dir)
    # items, subtotals and totals all read the lines: they are computed and written once
    doc = C.cart_document(m, stage_table(lines_of(m), "cart-lines"), EXPANDED)
    return doc.select("section", F.from_json("body", DOCUMENT_FIELDS).alias("o")).select("section", "o.*")


@register("cart_inventory", with_model(body="""
SELECT product_id, stock FROM inventory
WHERE product_id <> 1 AND product_id IN (SELECT product_id FROM shopping_cart)
GROUP BY product_id, stock"""), ids="J15 P13 U2")
@on_model
def cart_inventory(m):
    return C.cart_inventory(m)
