"""Bridges that let the rules run over the driver's tables.

Fact bridge: rows of `events` act as symbol events (scopes, declarations, uses, drivers);
`orders` and `customer` act as module references and definitions.
Text bridge: each row of `customer` (or `supplier`) renders one Verilog file from fixed templates,
which goes through lexer, parser, facts and rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.nodes import parse_files
from . import facts

#: Names per bridge, and every how many users stand for the global scope.
NAMES, GLOBAL_EVERY, MODULES = 40, 10, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as symbol events.

    click declares a variable, signup an instance; purchase reads, view writes, anything else reads and writes.
    Writes are driven by one of three processes, by the event's number (none for event_id % 4 = 3), so a name has several; a use of user u comes from a file
    with `default_nettype none if u % 3 = 0.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id")
    decl = F.when(F.col("event_type") == "click", "variable").when(F.col("event_type") == "signup", "instance")
    use = decl.isNull()
    read = use & (F.col("event_type") != "view")
    write = use & (F.col("event_type") != "purchase")
    driver = F.when(write & (F.col("event_id") % 4 < 3), F.col("event_id") % 4)
    seq = F.struct(F.lit(0).alias("file_idx"), F.col("event_id").cast("int").alias("pre"), F.lit(0).alias("sub"))
    scope = F.when(user % GLOBAL_EVERY == 0, facts.GLOBAL).otherwise(F.format_string("u%06d", user))
    return table(spark, sf_dir, "events").select(
        seq.alias("seq"), scope.alias("scope_id"), F.concat(F.lit("s"), (k % NAMES).cast("string")).alias("name"), F.when(use, "use").otherwise("decl").alias("ev"), decl.alias("decl_kind"),
        (~use & (k % 5 == 0)).alias("is_port"), F.coalesce(read, F.lit(False)).alias("read"), F.coalesce(write, F.lit(False)).alias("write"),
        F.when(driver.isNotNull(), F.concat(F.lit("p"), driver.cast("string"))).alias("driver_id"), F.when(driver.isNotNull(), driver + 1).cast("int").alias("driver_line"),
        F.lit("events").alias("file"), (F.col("event_id") + 1).cast("int").alias("line"), (k + 1).cast("int").alias("col"), (user % 3 == 0).alias("nettype_none"),
    )


def fact_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as module definitions: name by key modulo, two files by parity."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.format_string("c%06d", key).alias("scope_id"), F.lit("module").alias("kind"), F.concat(F.lit("m"), (key * 7 % MODULES).cast("string")).alias("name"), F.concat(F.lit("f"), (key % 2).cast("string"), F.lit(".v")).alias("file"),
        (key + 1).cast("int").alias("line"), F.lit(1).alias("col"), F.lit(facts.GLOBAL).alias("parent_id"), (key % 2).cast("int").alias("file_idx"), key.cast("int").alias("pre"),
    )


def fact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as module references; names reach beyond the defined ones."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), (F.col("o_custkey") * 7 % (MODULES + 20)).cast("string")).alias("name"), F.lit("top.v").alias("file"), (key + 1).cast("int").alias("line"), F.lit(3).alias("col"),
        F.struct(F.lit(2).alias("file_idx"), key.cast("int").alias("pre"), F.lit(0).alias("sub")).alias("seq"),
    )


#: Lines of a rendered file; {i} is the row's key, and a line is left out of the file's effect by its flag's text.
TEMPLATE = """{none}
module top_{i}(input logic clk, input logic sel);
  logic a{i}, b{i}, q;
  reg [7:0] mem;
  {inout}
  {init}
  {final}
  always @(posedge clk) begin
    a{i} {op} b{i};
    q = sel;
  end
  always_comb begin
    {comb}
    if (sel) mem[0] = a{i};
  end
  {latch}
  {pragma}
  case (sel)
    1'b0: begin
      assign w{i} = 1'b0;
    end
    {dflt}
  endcase
  {inst}
  {defparam}
  always_ff @(posedge clk) {uniq} {casez} (sel)
    default: b{i} += q;
  endcase
endmodule
"""


def flags() -> dict[str, tuple[str, str, str]]:
    """Placeholder -> (SQL condition on the key `i`, text if true, text if false)."""
    return {
        "none": ("i % 6 = 0", "`default_nettype none", "// nets"),
        "inout": ("i % 3 = 0", "inout wire io;", "wire io;"),
        "init": ("i % 4 = 0", "initial q = 0;", "// no start"),
        "final": ("i % 5 = 0", "final q = 0;", "// no end"),
        "op": ("i % 2 = 0", "<=", "="),
        "comb": ("i % 3 = 1", "mem = 8'h0;", "b{i} <= sel;"),
        "latch": ("i % 7 = 0", "always_latch q = sel;", "// no latch"),
        "pragma": ("i % 4 = 1", "// synopsys full_case", "// plain"),
        "dflt": ("i % 5 = 1", "default: begin end", "// open"),
        "inst": ("i % 2 = 1", "top_{j} u{i}(.clk(clk), .sel(q));", "other_{i} u{i}(q);"),
        "defparam": ("i % 6 = 1", "defparam u{i}.W = 8;", "// no param"),
        "uniq": ("i % 3 = 2", "unique", ""),
        "casez": ("i % 4 = 3", "casez", "case"),
    }


#: A task parses about so many files (6 MB of node rows of the full lint, as they are kept).
FILES_PER_TASK = 5_000


def text_files(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(file_idx, path, text): one rendered file per customer; instances of odd files name the next file's module.

    The keys are dealt over `parts` partitions, if given; texts are made behind that, so they are not shuffled.
    """
    key = F.col("c_custkey")
    text = F.lit(TEMPLATE)
    for name, (cond, yes, no) in flags().items():
        text = F.replace(text, F.lit("{" + name + "}"), F.expr(f"IF({cond}, {_quote(yes)}, {_quote(no)})"))
    text = F.replace(F.replace(text, F.lit("{i}"), F.col("i").cast("string")), F.lit("{j}"), (F.col("i") + 1).cast("string"))
    rows = table(spark, sf_dir, "customer").select(key.alias("i"))
    rows = rows if parts is None else rows.repartition(parts)
    return rows.select(F.col("i").cast("int").alias("file_idx"), F.concat(F.lit("f"), F.col("i").cast("string"), F.lit(".sv")).alias("path"), text.alias("text"))


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_nodes(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, kinds: frozenset | None = None) -> DataFrame:
    # parsing is the work, so it is spread over the cores; beyond that, tasks grow in number and not in size, as a kept
    # partition is sent whole to a task elsewhere, and parsed again there if it is not ready by then
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(1, cores, -(-table(spark, sf_dir, "customer").count() // FILES_PER_TASK))
    return parse_files(text_files(spark, sf_dir, n), columns, kinds)
