"""Column functions as Spark SQL text.

Every function takes SQL expressions and returns a SQL expression, to be used with
``F.expr`` or ``selectExpr``. All of them are evaluated inside the JVM. Text is used
instead of ``Column`` objects because a page extractor has thousands of nodes: as text
it reaches the parser in one call, while building it node by node from Python takes
seconds before the job even starts.
"""
