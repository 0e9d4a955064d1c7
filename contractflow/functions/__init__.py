"""Text, JSON and additively homomorphic encryption functions.

The text and JSON functions build SQL expression text: arguments are expressions (a column name or
any other SQL text) and so is the result.  Wrap it in ``F.expr`` for a Column, or hand it to
``selectExpr``.  Large expressions thus reach the planner in one call.
"""
