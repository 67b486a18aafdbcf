"""Sources: log files with line numbers, office documents and program code as tables, profiles of columns."""
