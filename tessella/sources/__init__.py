"""Reading and writing: files behind an allow-list, COPY formats, samples, foreign tables, changes of rows, cursors."""
