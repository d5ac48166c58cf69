"""Reading and writing of tables, files and exports."""
