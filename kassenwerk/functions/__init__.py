"""Column expressions shared by the queries. All of them stay inside the JVM."""
