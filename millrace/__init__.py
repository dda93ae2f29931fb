"""A SQL analytics engine on Spark with MySQL-flavoured semantics."""
