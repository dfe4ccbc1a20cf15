"""Registered queries over the driver's tables, each with its DuckDB SQL. The tables hold no listings, so operands such as
missing prices are derived from them, in the same words on both sides."""
