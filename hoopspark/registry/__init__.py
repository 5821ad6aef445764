"""Every operator bound to the test tables, with the SQL its result is checked against."""
