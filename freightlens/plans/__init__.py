"""Query registry (Spark plans) and their DuckDB SQL twins."""
