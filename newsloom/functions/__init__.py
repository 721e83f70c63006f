"""Part of newsloom; see the package README."""
