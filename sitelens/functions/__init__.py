"""Column functions: text, URLs, validation; and the HTML element reader."""
