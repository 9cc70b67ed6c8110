"""Facts derived from the node table: scopes, events, module definitions and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the facts read of the node table: columns, and kinds or classes of nodes.
COLUMNS = ["file_idx", "file", "pre", "ord", "cls", "name", "line", "col", "scope_pre", "proc_kind", "proc_line", "proc_col", "read", "write", "is_port", "has_init", "stmt_pre", "stmt_line", "stmt_col", "nettype_none"]
KINDS = frozenset({"ModuleDeclaration", "HierarchyInstantiation", "HierarchicalInstance", "Declarator", "IdentifierName", "IdentifierSelectName"})
#: Scope of everything outside modules.
GLOBAL = "global"


def scope_id(file_idx: Column, pre: Column) -> Column:
    return F.when(pre < 0, F.lit(GLOBAL)).otherwise(F.concat_ws(":", F.format_string("%010d", file_idx), F.format_string("%010d", pre)))


def _seq(pre: Column, sub) -> Column:
    return F.struct(F.col("file_idx"), pre.cast("int").alias("pre"), F.lit(sub).cast("int").alias("sub") if isinstance(sub, int) else sub.cast("int").alias("sub"))


def scopes(nodes: DataFrame) -> DataFrame:
    """Module scopes; the global scope is implied."""
    return nodes.where("cls = 'ModuleDeclaration'").select(scope_id(F.col("file_idx"), F.col("pre")).alias("scope_id"), F.lit("module").alias("kind"), "name", "file", "line", "col", F.lit(GLOBAL).alias("parent_id"), "file_idx", "pre")


def module_refs(nodes: DataFrame) -> DataFrame:
    return nodes.where("cls = 'HierarchyInstantiation' AND name IS NOT NULL").select("name", "file", "line", "col", _seq(F.col("pre"), 0).alias("seq"))


def driver_id() -> Column:
    """Process that writes: kind and place of the innermost one; null outside processes or for reads."""
    place = F.concat_ws(":", "proc_kind", F.coalesce("file", F.lit("")), F.col("proc_line"), F.col("proc_col"))
    return F.when(F.col("write") & F.col("proc_kind").isNotNull(), place)


_EVENT = ("seq", "scope_id", "name", "ev", "decl_kind", "is_port", "read", "write", "driver_id", "driver_line", "file", "line", "col", "nettype_none")


def events(nodes: DataFrame) -> DataFrame:
    """Declarations and uses in walk order (seq); one scan, one explode."""
    none = F.lit(None)

    def ev(kind, pre, sub, decl=None, port=None, read=None, write=None, driver=None, driver_line=None, line="line", col="col"):
        return F.struct(
            _seq(F.col(pre), sub).alias("seq"), F.lit(kind).alias("ev"), F.lit(decl).cast("string").alias("decl_kind"),
            (F.lit(False) if port is None else port).alias("is_port"), (F.lit(False) if read is None else read).alias("read"), (F.lit(False) if write is None else write).alias("write"),
            (none if driver is None else driver).cast("string").alias("driver_id"), (none if driver_line is None else driver_line).cast("int").alias("driver_line"), F.col(line).alias("line"), F.col(col).alias("col"),
        )

    named = nodes.where("name IS NOT NULL AND (cls IN ('Declarator', 'HierarchicalInstance', 'IdentifierName', 'IdentifierSelectName'))")
    driver = driver_id()
    made = F.array(
        F.when(F.col("cls") == "Declarator", ev("decl", "pre", 0, "variable", port=F.col("is_port"))),
        F.when((F.col("cls") == "Declarator") & F.col("has_init"), ev("use", "pre", 1, write=F.lit(True))),
        F.when((F.col("cls") == "HierarchicalInstance") & F.col("stmt_pre").isNotNull(), ev("decl", "stmt_pre", F.col("ord"), "instance", line="stmt_line", col="stmt_col")),
        F.when(F.col("cls").startswith("Identifier"), ev("use", "pre", 0, read=F.col("read"), write=F.col("write"), driver=driver, driver_line=F.when(driver.isNotNull(), F.col("proc_line")))),
    )
    e = named.select("name", "file", "nettype_none", scope_id(F.col("file_idx"), F.col("scope_pre")).alias("scope_id"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e"))
    return e.select("e.seq", "scope_id", "name", "e.ev", "e.decl_kind", "e.is_port", "e.read", "e.write", "e.driver_id", "e.driver_line", "file", "e.line", "e.col", "nettype_none")
